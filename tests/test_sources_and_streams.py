"""Readers and writers round trip; the landing stream gives what a batch gives."""

import json

import pytest
from pyspark.sql import functions as F

from assaymill.operators import merge
from assaymill.sources import readers, writers
from assaymill.streaming import landing


def test_readers(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"patents": [{"id": "P", "filename": "p.pdf", "notes": "", "pages": [{"page": 3, "expected_count": 2, "examples": "1,2"}, {"page": 4, "expected_count": 0, "notes": ""}]}]}))
    assert sorted(tuple(r) for r in readers.count_truth(spark, str(tmp_path / "truth.json")).select("patent", "page", "expected").collect()) == [("P", 3, 2), ("P", 4, 0)]
    (tmp_path / "labels.json").write_text(json.dumps({"7": {"image_file": "x", "n_structures": 1, "structures": {"1": {"type": "other", "id": None, "bbox": [1, 2, 3, 4]}}}}))
    assert tuple(readers.box_labels(spark, str(tmp_path / "labels.json"), "f").first()) == ("f", 7, 1, "other", None, 1, 2, 3, 4)
    (tmp_path / "pairs.csv").write_text("file_path,SMILES\nimg/US1_12a.png,C\\C=[N@H]/C\n")
    r = readers.image_pairs(spark, str(tmp_path / "pairs.csv")).first()
    assert (r.patent, r.compound_id, r.SMILES) == ("US1", "12a", "C\\C=[N@H]/C")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert [r.file_name for r in readers.documents(spark, str(tmp_path)).collect()] == ["a.pdf"]
    sheet = spark.createDataFrame([("12.0", "C"), ("12", "CC"), ("", "N")], "Compound string, `SMILES code` string")
    assert [tuple(r) for r in readers.truth_table(sheet).collect()] == [("12", "CC")]
    with pytest.raises(ValueError):
        readers.truth_table(sheet.select("Compound"))
    refs = spark.createDataFrame([("x/A.png",)], "ref string")
    files = spark.createDataFrame([("/d/a.jpg",), ("/d/a.tif",)], "path string")
    assert readers.resolved_images(refs, files).first().path == "/d/a.jpg"


def test_writers(spark, tmp_path):
    r = spark.createDataFrame(
        [(1, "f", "7", "example_compound", 1, 0, "C\\C", "CC", True, 16.0, 0.0, 1.25, 1, 0, "CH4", None, None, None, None, None)],
        "result_id long, source_file string, compound_id string, compound_type string, page int, structure_index int, smiles string, canonical string, is_valid boolean, mw double, clogp double, tpsa double, rot_bonds int, stereo int, formula string, formula_validation string, reference_formula string, reference_mass double, mass_error_ppm double, error string",
    )
    a = spark.createDataFrame([(1, "Ki, \"x\"", "5")], "result_id long, assay string, value string")
    writers.csv(r, a, str(tmp_path / "csv"), single=True)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()
    assert back.SMILES == "C\\C" and back['Ki, "x"'] == "5"
    writers.smiles(r, str(tmp_path / "smi"))
    assert [x.value for x in spark.read.text(str(tmp_path / "smi")).collect()] == ["CC"]
    writers.report(r, str(tmp_path / "txt"), single=True)
    assert spark.read.text(str(tmp_path / "txt")).first().value == "Total: 1"
    writers.html(r, str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html")).count() == 3
    rows = r.withColumn("molblock", F.lit("mol")).withColumn("properties", F.create_map(F.lit("Ki (%)"), F.lit("5")))
    assert writers.sdf(rows, str(tmp_path / "sdf"), single=True) == 1
    assert "> <Ki_pct>" in [x.value for x in spark.read.text(str(tmp_path / "sdf")).collect()]


def test_landing(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00'"
    data = [("f", 2, 0, "1", "k", "late", None), ("f", 1, 0, "1", "k", "first", None), ("f", 3, 1, "2", "k", "x", True), ("g", 1, 0, "1", "k", "open", None)]
    for k, row in enumerate(data):
        spark.createDataFrame([row], "file string, page int, rank int, compound_id string, assay string, value string, complete boolean").withColumn("at", F.expr(at)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = landing.merged_on_completion(landing.landed(spark, str(tmp_path / "in"), 1))
    progress = landing.Progress()
    spark.streams.addListener(progress)
    q = landing.start(stream, lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    spark.streams.removeListener(progress)
    done = spark.createDataFrame([r[:6] for r in data if r[0] == "f"], "file string, page int, rank int, compound_id string, assay string, value string")
    assert sorted(seen) == sorted(tuple(r) for r in merge.merge_records(done, ["file", "compound_id", "assay"], ["page", "rank"]).collect())
