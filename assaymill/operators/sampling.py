"""Splits, oversampling and labelled sets for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stratified_split(df: DataFrame, group: str, key: str, share: float = 0.1) -> DataFrame:
    """``split``: of each group the whole part of ``share`` of its rows, at
    least one, in the order of their keys' MD5, are validation."""
    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("split", F.when(F.row_number().over(order) <= F.greatest(F.lit(1), F.floor(n * F.lit(share))), "val").otherwise("train"))


def oversample(df: DataFrame, times) -> DataFrame:
    """Every row as often as ``times`` says; 0 leaves it out."""
    rows = df.withColumn("_n", times.cast("int")).where("_n > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def assembled(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of the sources in order, null keys dropped, of equal keys the
    first source's first row kept; ``source_name`` says which."""
    out = None
    for k, (name, df) in enumerate(sources.items()):
        one = df.withColumn("source_name", F.lit(name)).withColumn("_rank", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_rank")]
    first = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("_rank", *rest)).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def hard_examples(failures: DataFrame, below: float = 0.95, times: int = 5) -> DataFrame:
    return oversample(failures.where(F.col("similarity") < below), F.lit(times))


def expected_labels(structures: DataFrame, truth: DataFrame) -> DataFrame:
    """Structures whose id the truth has are examples, the others not."""
    from ..functions.text import truth_id

    t = truth.select("file", truth_id(F.col("compound_id")).alias("_id"), F.lit(True).alias("_yes")).distinct()
    s = structures.withColumn("_id", truth_id(F.col("compound_id")))
    return s.join(t, ["file", "_id"], "left").withColumn("label", F.when(F.col("_yes"), "example_compound").otherwise("other")).drop("_id", "_yes")


def label_manifest(labels: DataFrame) -> DataFrame:
    """Per file: pages, boxes, examples, others and distinct ids, as columns and
    as one JSON text."""
    per = labels.groupBy("file").agg(
        F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("boxes"), F.count_if(F.col("type") == "example_compound").alias("examples"), F.count_if(F.col("type") == "other").alias("others"), F.countDistinct("id").alias("ids")
    )
    return per.withColumn("manifest", F.to_json(F.struct(*per.columns)))
