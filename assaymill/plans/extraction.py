"""Whole plans: assay extraction, record assembly, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, metrics, ordered, pages, tables


def assay_records(cells: DataFrame, text_pages: DataFrame | None = None, ocr: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``file, compound_id, assay, value``: native tables first; pages whose
    native result is poor are filled from recognised records, pages without any
    from their text, then from recognised records; first filled value by page
    and source.  ``parts`` are the partitions of the tables' shuffles, by default
    one per 250,000 rows of cells."""
    parts = parts or ordered.parts(cells)
    good = tables.is_biological(cells, parts)
    native = tables.long_assays(cells, good, parts).select("file", "page", F.col("table_no").alias("part"), "compound_id", "assay", "value", F.lit(0).alias("rank"))
    out = native
    if text_pages is not None:
        rest = text_pages.join(native.select("file", "page").distinct(), ["file", "page"], "left_anti")
        out = out.unionByName(tables.text_lines(rest).select("file", "page", F.col("line_no").alias("part"), "compound_id", "assay", "value", F.lit(1).alias("rank")))
    if ocr is not None:
        poor = tables.low_quality(out, ["file", "page"]).where("not low_quality").select("file", "page")
        out = out.unionByName(ocr.join(poor, ["file", "page"], "left_anti").select("file", "page", F.lit(0).alias("part"), "compound_id", "assay", "value", F.lit(2).alias("rank")))
    return merge.merge_records(out, ["file", "compound_id", "assay"], ["page", "rank", "part"])


def merged_results(structures: DataFrame, records: DataFrame) -> DataFrame:
    """``structure_id, file, page, compound_id, assay_id, rung, bio_data`` of all
    structures; assays as a map, null where no id fits.  The maps are read by
    the ladder and by the final join, so they are persisted."""
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("assay", "value"))))
    assays = records.groupBy("file", F.col("compound_id").alias("assay_id")).agg(entry.alias("bio_data")).persist()
    hits = merge.id_ladder(structures, assays).drop("compound_id")
    return structures.join(hits, ["structure_id", "file"], "left").join(assays, ["file", "assay_id"], "left")


def processed_pages(text_pages: DataFrame, classes: DataFrame) -> DataFrame:
    """Pages of the examples section that have structures or tables."""
    section = pages.section_pages(text_pages, pages.section_bounds(text_pages))
    return pages.pages_to_process(section, classes.where("should_process").select("file", "page"), text_pages.select("file", "page"))


def evaluation(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per file: truths, found, exact, mean similarity of the found,
    extra ids."""
    best = metrics.evaluate(truth, predictions)
    per = best.groupBy("file").agg(
        F.count(F.lit(1)).alias("truths"), F.count("canonical").alias("found"), F.count_if(F.col("similarity") == 1.0).alias("exact"), F.round(F.avg(F.when(F.col("canonical").isNotNull(), F.col("similarity"))), 6).alias("mean_similarity")
    )
    extra = metrics.extra_ids(truth, predictions).groupBy("file").agg(F.count(F.lit(1)).alias("extra"))
    return per.join(extra, "file", "left").fillna(0, ["extra"])
