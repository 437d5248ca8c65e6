"""Best candidates, first occurrences, stable partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_connected(candidates: DataFrame, by: list[str], smiles: str = "smiles", at: str = "attempt", whole: bool = False) -> DataFrame:
    """The first candidate in one piece, else the first of all, cut to its
    largest fragment where that dominates (``whole`` leaves it as it is); blank
    and null candidates don't count."""
    from ..functions.text import largest_fragment

    c = candidates.where(F.coalesce(F.col(smiles), F.lit("")) != "")
    broken = F.contains(F.col(smiles), F.lit("."))
    return c.groupBy(*by).agg(F.min_by(F.col(smiles) if whole else F.when(broken, largest_fragment(F.col(smiles))).otherwise(F.col(smiles)), F.struct(broken, at)).alias(smiles))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return best(df, keys, [F.col(c) for c in order])


def to_top(df: DataFrame, checked: str, order: str) -> DataFrame:
    """Checked rows first, both parts in their old order."""
    return df.orderBy(F.col(checked).desc(), F.col(order))


def coalesce_tiers(*tiers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key the first tier's value of each column that isn't null, and the
    names of the tiers used, joined by ``+``."""
    out = None
    for k, tier in enumerate(tiers):
        t = tier.select(key, *[F.col(c).alias(f"_{k}_{c}") for c in columns])
        out = t if out is None else out.join(t, key, "full")
    pick = [F.coalesce(*[F.col(f"_{k}_{c}") for k in range(len(tiers))]).alias(c) for c in columns]
    used = []
    for k in range(len(tiers)):
        news = [F.col(f"_{k}_{c}").isNotNull() & (F.coalesce(*[F.col(f"_{j}_{c}") for j in range(k)]).isNull() if k else F.lit(True)) for c in columns]
        any_ = news[0]
        for x in news[1:]:
            any_ = any_ | x
        used.append(F.when(any_, F.lit(str(k))))
    return out.select(key, *pick, F.concat_ws("+", *used).alias("tiers"))
