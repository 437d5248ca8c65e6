"""Operators on small frames: edge cases, ties, order independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.operators import choose, export, layout, matching, merge, metrics, ordered, pages, pixels, sampling, tables, words
from assaymill.plans import backends, extraction


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def cells(spark, rows, page=1, table=1):
    return spark.createDataFrame([("f", page, table, k, r) for k, r in enumerate(rows)], "file string, page int, table_no int, row_no int, cells array<string>")


def test_tables(spark):
    c = cells(spark, [["Compound", "ICso", None, "Ki", "Ki"], ["Example 1", "5 nM", "x", "++"], ["Example 2", "-", None, "3", "4"], ["1", "7 nM"], ["none", "9"]])
    assert got(tables.long_assays(c), "compound_id", "assay", "value") == [("1", "IC50", "7 nM"), ("2", "Ki", "4")]
    assert tables.is_biological(c).count() == 1
    assert tables.is_biological(cells(spark, [["a", "b"], ["c", "d"]])).count() == 0
    text = spark.createDataFrame([("f", 1, "IC50 Ki\n12 5 nM ++\n1H 3 nM\nx"), ("f", 2, "1H NMR 400 MHz dmso\n1 5 nM")], "file string, page int, text string")
    assert got(tables.text_lines(text), "page", "compound_id", "assay", "value") == [(1, "12", "ic50", "5 nM"), (1, "12", "ki", "++")]
    triples = spark.createDataFrame([("f", 1, "compound 7: IC50 = 5 nM, cpd 7 ic50 6 nM; example 8 Ki: ++")], "file string, page int, text string")
    assert got(tables.text_triples(triples), "compound_id", "assay", "value") == [("7", "ic50", "6 nM"), ("8", "ki", "++")]
    a = spark.createDataFrame([(1, "1", "k", "a"), (1, "2", "k", None)], "page int, compound_id string, assay string, value string")
    b = spark.createDataFrame([(1, "2", "k", "b"), (1, "3", "k", "c")], "page int, compound_id string, assay string, value string")
    assert got(tables.better_of(a, b, ["page"]), "compound_id", "value") == [("1", "a"), ("2", "b"), ("3", "c")]


def test_merge(spark):
    r = spark.createDataFrame([("a", 2, "late"), ("a", 1, ""), ("a", 1, "first"), ("b", 1, None)], "k string, page int, value string")
    assert got(merge.merge_records(r, ["k"], ["page"]), "k", "value") == [("a", "first")]
    s = spark.createDataFrame([(1, "f", "Example 7"), (2, "f", "12A"), (3, "f", "100-7"), (4, "g", "7"), (5, "f", None), (6, "f", "0009")], "structure_id long, file string, compound_id string")
    a = spark.createDataFrame([("f", "7"), ("f", "12a"), ("f", "100-7"), ("f", "9x")], "file string, assay_id string")
    assert got(merge.id_ladder(s, a), "structure_id", "assay_id", "rung") == [(1, "7", 2), (2, "12a", 3), (3, "100-7", 1), (6, "9x", 8)]
    assert got(merge.unmatched(a, merge.id_ladder(s.where("structure_id < 4"), a)), "assay_id") == [("9x",)]
    refs = spark.createDataFrame([("f", 1, 1, "CH4", None, "8"), ("f", 1, 2, "C2H6O", 47.0, "9")], "file string, page int, seq int, formula string, mh_mass double, compound_id string")
    st = spark.createDataFrame([(1, "f", 1, "8", "C2H6O", 46.041865), (2, "f", 1, None, "C2H6O", 46.041865), (3, "f", 9, None, "C", 12.0)], "structure_id long, file string, page int, compound_id string, formula string, exact_mass double")
    assert got(merge.best_reference(st, refs), "structure_id", "status") == [(1, "mismatch"), (2, "match"), (3, "no_reference")]


def test_clusters(spark):
    df = spark.createDataFrame([(1, v) for v in (100, 0, 30, 20, 10)], "k int, v int").repartition(5)
    assert [c for _, c in got(ordered.chained(df, ["k"], "v", 15), "v", "cluster")] == [1, 1, 2, 1, 1] or sorted(c for _, c in got(ordered.chained(df, ["k"], "v", 15), "v", "cluster")) == [1, 1, 1, 1, 2]
    assert dict(got(ordered.anchored(df, ["k"], "v", 15), "v", "cluster")) == {0: 1, 10: 1, 20: 2, 30: 2, 100: 3}
    assert ordered.merged_segments([0, 5, 40, 90], 20) == [0, 40, 90]


def test_next_ids_match_the_recurrence(spark):
    rng = np.random.default_rng(1)
    data = [(d, p, int(rng.integers(0, 4)), None if rng.random() < 0.5 else int(rng.integers(0, 30))) for d in range(40) for p in range(8)]
    df = spark.createDataFrame(data, "file int, page int, n int, d int")
    expected = {}
    for f in range(40):
        at = 1
        for _, p, n, d in (r for r in data if r[0] == f):
            expected[f, p] = at
            at = max(d + 1 if d is not None else 0, at + n)
    assert {(r.file, r.page): r.start_id for r in ordered.next_ids(df, ["file"], ["page"], "n", "d").collect()} == expected


def test_limits(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, 5, 6, 500, 700, 701, 703)] + [(2, 9)], "k int, v int")
    assert got(ordered.inside_limits(df, ["k"], "v").where("k = 1"), "v") == sorted([(v,) for v in (1, 2, 3, 4, 5, 6, 500, 700, 701, 703)], key=repr)
    tight = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, 5, 6, 7, 500)], "k int, v int")
    assert (500,) not in got(ordered.inside_limits(tight, ["k"], "v"), "v")


def test_matching(spark):
    a = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0), (1, 3, 500.0)], "page int, a long, y double")
    b = spark.createDataFrame([(1, 7, 12.0), (1, 8, 10.5), (2, 9, 1.0)], "page int, b long, z double")
    assert got(matching.nearest(a, b, ["page"], "y", "z", 100, "a", "b"), "a", "b") == [(1, 8), (2, 7)]
    t = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 50, 50, 60, 60)], "page int, truth_id long, x1 int, y1 int, x2 int, y2 int")
    f = spark.createDataFrame([(1, 5, 0, 0, 10, 9), (1, 6, 100, 100, 110, 110)], "page int, found_id long, x1 int, y1 int, x2 int, y2 int")
    m = matching.by_overlap(t, f, ["page"])
    assert got(m, "truth_id", "found_id") == [(1, 5)]
    assert got(matching.page_scores(t, f, m, ["page"]), "recall", "precision", "missed", "false") == [(0.5, 0.5, 1, 1)]


def test_layout(spark):
    b = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 40, 1, 60, 9), (1, 0, 100, 10, 110), (2, 0, 0, 5, 5)], "page int, x1 int, y1 int, x2 int, y2 int")
    assert got(layout.merged(b, ["page"]), "page", "x1", "y1", "x2", "y2", "parts") == [(1, 0, 0, 60, 10, 2), (1, 0, 100, 10, 110, 1), (2, 0, 0, 5, 5, 1)]
    c = spark.createDataFrame([(1, "picture", 0.9), (1, "picture", 0.4), (1, "table", 0.1), (2, "text", 0.9)], "page int, label string, conf double")
    out = {r.page: r for r in layout.page_classes(c, ["page"]).collect()}
    assert out[1].categories == {"picture": 2} and out[1].should_process and not out[2].should_process
    grid = spark.createDataFrame([(1, 10, 100 * k, 50, 100 * k + 60, 1000) for k in (0, 1, 2, 4, 5)] + [(1, 600, 0, 650, 60, 1000)], "page int, x1 int, y1 int, x2 int, y2 int, page_w int")
    assert got(layout.filled_columns(grid, ["page"]), "side", "x1", "y1", "y2") == [("left", 10, 300, 360)]
    tc = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (2, 1, 0, 10), (2, 2, 10, 20)], "t int, column_no int, x1 int, x2 int")
    held = layout.structure_columns(tc, spark.createDataFrame([(1, 2, 6)], "t int, x1 int, x2 int"), tc.limit(0), ["t"])
    assert got(held, "t", "column_no") == [(1, 1), (2, 2)]
    cols = spark.createDataFrame([(1, 0, 10, 100), (1, 20, 80, 100), (2, 0, 5, 100)], "t int, x1 int, x2 int, table_w int")
    assert got(layout.wide_columns(cols, ["t"]), "t", "x1") == [(1, 20), (2, 0)]


def test_metrics(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    s = metrics.set_scores(ids(1, 2, 3), ids(1, 9), ids(1, 2, 4), "k").first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall) == (2, 1, 2, 0.6667, 0.5)
    empty = ids().limit(0) if False else spark.createDataFrame([], "k int")
    assert metrics.set_scores(empty, empty, empty, "k", empty=1.0).first().f1 == 1.0
    t = spark.createDataFrame([("f", "7", "CC"), ("f", "8", "C")], "file string, compound_id string, smiles string")
    p = spark.createDataFrame([("f", 1, 0, "Example 7", "CC.C", 1.0), ("f", 2, 0, "7.0", "CCC", 0.6), ("f", 3, 0, "99", "C", 0.1)], "file string, page int, structure_index int, compound_id string, canonical string, similarity double")
    assert got(metrics.evaluate(t, p), "compound_id", "canonical") == [("7", "CCC"), ("8", None)]
    e = extraction.evaluation(t, p).first()
    assert (e.truths, e.found, e.exact, e.extra) == (2, 1, 0, 1)
    pairs = spark.createDataFrame([("table", "table"), ("text_only", "structures"), ("structures", "structures")], "expected string, predicted string")
    b = metrics.binary_scores(pairs).first()
    assert (b.tp, b.fp, b.fn, b.tn, b.exact) == (2, 1, 0, 0, 0.6667)


def test_pages(spark):
    assert pages.page_range("1-3, 5", 9) == {1, 2, 3, 5} and pages.page_range(" ", 2) == {1, 2}
    for bad in ("1,,2", "x", "0", "10", "3-1"):
        with pytest.raises(ValueError):
            pages.page_range(bad, 9)
    df = spark.createDataFrame([("3-4, 1, 3, 12, x",)], "s string")
    assert df.select(pages.page_list(F.col("s"), F.lit(10)), pages.sorted_pages(F.col("s"))).first() == ([3, 4, 1, 3], [1, 3, 4, 12])
    p = lambda *v: spark.createDataFrame(list(v), "file string, page int")
    out = pages.pages_to_process(p(("a", 1), ("b", 1)), p(("a", 1), ("a", 2), ("b", 2)), p(("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)))
    assert got(out, "file", "page") == [("a", 1), ("b", 1), ("b", 2)]


def test_choose_and_split(spark):
    c = spark.createDataFrame([(1, 1, "CCCCCC.C"), (1, 2, "CC"), (2, 1, "CCCCCC.C"), (3, 1, None)], "k int, attempt int, smiles string")
    assert got(choose.first_connected(c, ["k"]), "k", "smiles") == [(1, "CC"), (2, "CCCCCC")]
    a = spark.createDataFrame([("f", 1, None)], "file string, s int, c int")
    b = spark.createDataFrame([("f", 2, 9), ("g", 3, None)], "file string, s int, c int")
    assert got(choose.coalesce_tiers(a, b, key="file", columns=["s", "c"]), "file", "s", "c", "tiers") == [("f", 1, 9, "0+1"), ("g", 3, None, "1")]
    d = spark.createDataFrame([("a", k) for k in range(25)] + [("b", 1)], "g string, k int")
    split = sampling.stratified_split(d, "g", "k")
    assert got(split.where("split = 'val'").groupBy("g").count(), "g", "count") == [("a", 2), ("b", 1)]
    assert got(sampling.stratified_split(d.repartition(7), "g", "k"), "g", "k", "split") == got(split, "g", "k", "split")
    assert sampling.oversample(d, F.lit(3)).count() == 78


def test_export(spark):
    r = spark.createDataFrame(
        [(1, "f.pdf", "7", "example_compound", 1, 0, "C", "C", True, 16.0, 0.0, 1.25, 1, 0, "CH4", None, None, None, None, None), (2, "f.pdf", None, "other", 1, 1, None, None, False, None, None, None, None, None, None, None, None, None, None, "bad")],
        "result_id long, source_file string, compound_id string, compound_type string, page int, structure_index int, smiles string, canonical string, is_valid boolean, mw double, clogp double, tpsa double, rot_bonds int, stereo int, formula string, formula_validation string, reference_formula string, reference_mass double, mass_error_ppm double, error string",
    )
    a = spark.createDataFrame([(1, "Kd", "5"), (1, "beta", "x"), (2, "IC50 (nM)", "7"), (2, "Alpha", "y")], "result_id long, assay string, value string")
    assert export.assay_columns(a) == ["IC50 (nM)", "Kd", "Alpha", "beta"]
    wide = export.wide(r, a)
    assert wide.columns == ["result_id", *export.FIXED, "IC50 (nM)", "Kd", "Alpha", "beta"]
    first = wide.where("result_id = 1").first()
    assert (first.Structure, first.Valid, first.MW_Da, first.cLogP, first["IC50 (nM)"], first.Kd) == ("1", "Yes", "16.00", "0.00", "", "5")
    assert export.kept_rows(r, True, True).count() == 1 and export.smiles_lines(r).collect()[0].value == "C"
    assert "ERROR: bad" in export.report_lines(r).where("result_id = 2").first().text


def test_words(spark):
    w = words.from_text(spark.createDataFrame([(1, "ab cd\ne")], "d int, t string"), "d", "t")
    assert got(w, "line", "text", "x", "y") == [(0, "ab", 0, 0), (0, "cd", 24, 0), (1, "e", 0, 20)]
    boxes = [("f", 1, k, t, x, y, 20, 10, 90, 600, 800) for k, (t, x, y) in enumerate([("1", 10, 200), ("2", 10, 230), ("3", 12, 260), ("5", 300, 202), ("7", 300, 231), ("+444", 305, 262)])]
    df = spark.createDataFrame(boxes, "file string, page int, seq int, text string, x int, y int, w int, h int, conf int, page_w int, page_h int")
    ids = words.ids_of(df)
    assert got(ids, "compound_id") == [("1",), ("2",), ("3",)]
    cols = words.numeric_columns(df, ids)
    assert got(cols, "assay", "x_low") == [("Assay_1", 300)]
    assert got(words.values_by_column(df, cols, ids), "compound_id", "value") == [("1", "5"), ("2", "7"), ("3", "++++")]
    assert got(words.rows_of(df), "seq", "row") == [(0, 1), (1, 2), (2, 3), (3, 1), (4, 2), (5, 3)]


def test_pixels(spark):
    page = np.full((200, 300), 255, np.uint8)
    page[40:140, 50:150:3] = 0
    page[90, 50:150] = 0
    page[180, :] = 0
    assert pixels.components(page < 128)[0] == (0, 180, 300, 181)
    assert pixels.drawings(page) == [(50, 40, 150, 140)]
    assert pixels.separators(page, 1) == [180] and pixels.text_lines(page) == 2
    assert pixels.autocrop(page)[1] < 45 and pixels.extended(page, (50, 60, 150, 100))[1] == 40
    assert abs(pixels.correlation(page, page) - 1) < 1e-9 and pixels.correlation(page[:5], page[:5]) == 0.0
    assert pixels.enhanced(page, "square").shape == (384, 384)
    assert pixels.trimmed_overlaps([(10, 10, 20, 20), (24, 10, 30, 20)], 5) == [(5, 5, 22, 25), (22, 5, 35, 25)]
    sheet = np.full((700, 900), 255, np.uint8)
    for y in (50, 400):
        for x in (50, 500):
            sheet[y : y + 200 : 4, x : x + 300] = 0
            sheet[y : y + 200, x : x + 300 : 5] = 0
    assert len(pixels.split_box(sheet, (0, 0, 900, 700))) == 4 and pixels.split_box(page, (50, 40, 150, 140)) == [(50, 40, 150, 140)]
    assert pixels.subdivided(sheet, [0, 700]) == [0, 325, 700] and pixels.tightened(sheet) == (50, 350)
    assert pixels.anchored_rows([100, 300], [110]) == [108, 300] and pixels.accepted(sheet, (50, 50, 350, 250), (500, 50, 800, 250))
    assert len(pixels.filled_rows(sheet, (0, 0, 900, 700), (40, 460), [0, 325, 700], [(50, 50, 350, 250)])) == 2
    assert pixels.located(sheet[::4, ::4], sheet[0:320:4, 0:480:4], (1.0,)) == (0, 0, 120, 80)
    two = spark.createDataFrame([("f", p, bytearray(page.tobytes()), 300, 200) for p in (2, 1)], "file string, page int, gray binary, width_px int, height_px int")
    counted = pixels.ordered_detection(two, lambda _, state: [(state.setdefault("n", state.get("n", 0)), 0, 1, 1)] if state.update(n=state.get("n", 0) + 1) is None else [])
    assert got(counted, "page", "x1") == [(1, 1), (2, 2)]
    df = spark.createDataFrame([("f", 1, bytearray(page.tobytes()), 300, 200), ("f", 2, None, 1, 1)], "file string, page int, gray binary, width_px int, height_px int")
    assert got(pixels.detect(df), "page", "x1", "y1") == [(1, 50, 40)]
    ink = pixels.test(pixels.has_structure_ink)(F.col("gray"), F.col("width_px"), F.col("height_px"))
    assert got(df.select("page", ink.alias("ink")), "page", "ink") == [(1, True), (2, None)]


def test_backends(spark):
    assert backends.available("predict")[0] is False
    with pytest.raises(KeyError):
        backends.register("nothing", spark.range(1))

    def one(row):
        if row["smiles"] == "bad":
            raise ValueError("no")
        return [{"is_valid": True, "canonical": row["smiles"]}]

    backends.register("chem_props", backends.guarded(one, "chem_props"))
    out = backends.apply("chem_props", spark.createDataFrame([("C",), ("bad",)], "smiles string"))
    assert got(out, "smiles", "is_valid", "error") == [("C", True, None), ("bad", None, "ValueError: no")]
    backends.register("chem_props", spark.createDataFrame([("C", True), ("N", True)], "smiles string, is_valid boolean"))
    assert got(backends.apply("chem_props", spark.createDataFrame([("C",)], "smiles string")), "smiles") == [("C",)]
    backends._REGISTERED.clear()
