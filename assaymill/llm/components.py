"""Connected components by alternating large-star and small-star rounds.

All steps are joins and aggregations; each round is checkpointed in the shared
folder, and links never leave the executors.  Hubs are reduced by partial
aggregation, and the join that carries the minimum back can be split by
adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Links every ``v`` of ``pairs (u, v)`` for which ``keep`` holds, and ``u``
    itself, to the smallest of ``u`` and its ``v``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u")
    return out.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; the component is
    the smallest node reachable.  Loops and repeated links are allowed, links
    with a null end are ignored; no links give no rows."""
    links = links.where("a is not null and b is not null and a <> b")
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
