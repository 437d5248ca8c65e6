"""Scorecards, set metrics, similarity bands, confusion, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def scorecard(truth: DataFrame, found: DataFrame, group: str, unit: str) -> DataFrame:
    """Per group and in all (group null, ``total`` 1): units, those with the
    exact count, expected, detected, delta and the whole percentage.  A unit
    nobody found counts 0."""
    both = truth.join(found, [group, unit], "left").withColumn("detected", F.coalesce("detected", F.lit(0)))
    out = both.rollup(group).agg(
        F.grouping(group).cast("int").alias("total"), F.count(F.lit(1)).alias("units"), F.count_if(F.col("expected") == F.col("detected")).alias("passed"),
        F.sum("expected").alias("expected"), F.sum("detected").alias("detected"), F.sum(F.abs(F.col("detected") - F.col("expected"))).alias("off"),
    )
    return out.withColumn("delta", F.col("detected") - F.col("expected")).withColumn("percent", F.floor(100 * F.col("passed") / F.col("units")).cast("int"))


def page_verdict(expected: Column, detected: Column) -> Column:
    d = F.coalesce(detected, F.lit(0)) - expected
    return F.when(d == 0, "PASS").when(d > 0, F.concat(F.lit("OVER(+"), d, F.lit(")"))).otherwise(F.concat(F.lit("MISS("), d, F.lit(")")))


def set_scores(predicted: DataFrame, rejected: DataFrame, truth: DataFrame, key: str, empty: float = 0.0) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` over id sets: an id predicted both
    ways counts as found and as missed.  Ratios to 4 places; empty denominators
    give ``empty``."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(1))
    all_ = flag(predicted, "p").join(flag(rejected, "r"), key, "full").join(flag(truth, "g"), key, "full").fillna(0, ["p", "r", "g"])
    s = all_.agg(
        F.coalesce(F.sum(F.col("p") * F.col("g")), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("p") * (1 - F.col("g"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.col("g") * F.greatest(F.col("r"), 1 - F.col("p"))), F.lit(0)).alias("fn"),
    )
    return with_ratios(s, empty)


def with_ratios(counts: DataFrame, empty: float = 0.0) -> DataFrame:
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(empty))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(empty))
    f1 = F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(empty))
    out = counts.withColumn("_p", p).withColumn("_r", r).withColumn("f1", F.round(f1, 4))
    return out.withColumn("precision", F.round("_p", 4)).withColumn("recall", F.round("_r", 4)).drop("_p", "_r")


def similarity_bands(pairs: DataFrame, group: str) -> DataFrame:
    """Per group and in all: how many are invalid, exact, at 0.9 or more, 0.5 to
    0.9, or below, and the mean similarity over all."""
    s = F.col("similarity")
    return pairs.rollup(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(F.col("is_valid") & (s == 1)).alias("exact"), F.count_if(F.col("is_valid") & (s >= 0.9)).alias("high"),
        F.count_if(F.col("is_valid") & (s >= 0.5) & (s < 0.9)).alias("middle"), F.count_if(F.col("is_valid") & (s < 0.5)).alias("low"), F.round(F.avg(s), 6).alias("mean_similarity"),
    )


def confusion(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """Expected classes by predicted ones, and each class's accuracy."""
    table = pairs.groupBy("expected").pivot("predicted", classes).agg(F.count(F.lit(1))).fillna(0, classes)
    total = sum((F.col(c) for c in classes), F.lit(0))
    right = F.coalesce(*[F.when(F.col("expected") == c, F.col(c)) for c in classes], F.lit(0))
    return table.withColumn("n", total).withColumn("accuracy", F.round(F.try_divide(right, total), 4))


def binary_scores(pairs: DataFrame) -> DataFrame:
    """Of pages to be processed or not, from their classes."""
    e, p = F.col("expected") != "text_only", F.col("predicted") != "text_only"
    counts = pairs.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"), F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 4).alias("exact"))
    return with_ratios(counts)


def class_from_labels(labels: Column, strict: bool = False) -> Column:
    """A page's class from its set of region labels: tables before structures
    before text; the strict rule asks for a picture or formula beside text."""
    has = lambda *names: F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
    structures = has("picture", "formula", "isolate_formula", "figure") if not strict else has("picture", "figure") | (has("formula") & has("text", "plain text"))
    return F.when(has("table"), "table").when(structures, "structures").otherwise("text_only")


def summary(results: DataFrame) -> DataFrame:
    """``total, valid, invalid, failed, pages, percent``: a result with an empty
    structure failed; pages are counted by number."""
    empty = F.coalesce(F.col("smiles"), F.lit("")) == ""
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    s = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(F.col("smiles").isNotNull() & ~valid).alias("invalid"), F.count_if(empty).alias("failed"), F.countDistinct("page").alias("pages")
    )
    return s.withColumn("percent", F.round(F.coalesce(F.try_divide(100 * F.col("valid"), F.col("total")), F.lit(0.0)), 4))


def evaluate(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each truth (``file, compound_id, smiles``) with its best prediction
    (``file, page, structure_index, compound_id, canonical, similarity``): by
    similarity, half a point more for a single fragment, the earliest of ties;
    null where nothing has its id."""
    t = truth.withColumn("_id", T.truth_id(F.col("compound_id")))
    p = predictions.select("file", T.truth_id(F.col("compound_id")).alias("_id"), "canonical", "similarity", "page", "structure_index")
    single = F.when(~F.contains(F.col("canonical"), F.lit(".")), 0.5).otherwise(0.0)
    both = t.join(p, ["file", "_id"], "left")
    return both.groupBy("file", "compound_id", "smiles").agg(
        F.min_by(F.struct("canonical", "similarity", "page", "structure_index"), F.struct(-(F.coalesce("similarity", F.lit(0.0)) + F.coalesce(single, F.lit(0.0))), "page", "structure_index")).alias("best")
    ).select("file", "compound_id", "smiles", "best.*")


def extra_ids(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted ids the truth doesn't have."""
    return predictions.select("file", T.truth_id(F.col("compound_id")).alias("id")).where("id is not null").distinct().join(truth.select("file", T.truth_id(F.col("compound_id")).alias("id")), ["file", "id"], "left_anti")


def approach_summary(results: DataFrame, approaches: list[str] | None = None) -> DataFrame:
    """``file, page, approach, n, mean_w, mean_h, valid``: crops of each
    approach on a page, their mean sizes, and how many gave a structure (neither
    blank nor an error text).  ``approaches`` names those to list; null keys
    are groups."""
    some = results if approaches is None else results.where(F.col("approach").isin(approaches))
    good = (F.coalesce(F.col("smiles"), F.lit("")) != "") & ~F.startswith(F.col("smiles"), F.lit("ERROR"))
    return some.groupBy("file", "page", "approach").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("crop_w"), 6).alias("mean_w"), F.round(F.avg("crop_h"), 6).alias("mean_h"), F.count_if(good).alias("valid"))
