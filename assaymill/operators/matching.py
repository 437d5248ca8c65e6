"""Greedy one-to-one matching within a page.

Every match is decided in order and takes its partner away, which no join can
say; so each page (a bounded group by nature) is matched by a grouped function
over arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import by_group


def greedy(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str], left_values: list[str], right_values: list[str], cost: Callable[[list, list], np.ndarray], limit: float, left_id: str, right_id: str) -> DataFrame:
    """``by, left_id, right_id, cost``: each left row in order takes the unused
    right row of least cost below the limit; of equal costs the first in the
    right order.  Order and value columns are numbers, as many on either side;
    ids are longs."""
    number = lambda names, k, to: F.col(names[k]).cast("double").alias(f"_{to}{k}") if k < len(names) else F.lit(0.0).alias(f"_{to}{k}")
    n_order, n_value = max(len(left_order), len(right_order)), len(left_values)

    def side(df: DataFrame, k: int, name: str, order: list[str], values: list[str]) -> DataFrame:
        return df.select(*by, F.lit(k).alias("_side"), F.col(name).cast("long").alias("_id"), *[number(order, j, "o") for j in range(n_order)], *[number(values, j, "v") for j in range(n_value)])

    both = side(left, 0, left_id, left_order, left_values).unionByName(side(right, 1, right_id, right_order, right_values))

    def make(key: tuple, columns: list) -> list[tuple]:
        sides, ids, values = columns[0], columns[1], columns[2:]
        n = int(np.searchsorted(sides, 1))
        if n == 0 or n == len(sides):
            return []
        table = np.array(cost([v[:n] for v in values], [v[n:] for v in values]), np.float64)
        out = []
        for i in range(n):
            j = int(np.argmin(table[i]))
            if table[i, j] < limit:
                out.append((int(ids[i]), int(ids[n + j]), float(table[i, j])))
                table[:, j] = np.inf
        return out

    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", `{left_id}` bigint, `{right_id}` bigint, cost double"
    order = ["_side", *[f"_o{k}" for k in range(n_order)], "_id"]
    return by_group(both, by, order, ["_side", "_id", *[f"_v{k}" for k in range(n_value)]], make, schema)


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, limit: float, left_id: str, right_id: str, left_order: list[str] | None = None) -> DataFrame:
    """Greedy matching by distance in one coordinate."""
    return greedy(left, right, by, left_order or [left_id], [right_at], [left_at], [right_at], lambda a, b: np.abs(a[0][:, None] - b[0][None]), limit, left_id, right_id)


def by_overlap(truth: DataFrame, found: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """Boxes of the truth (``truth_id, x1..y2``) matched to found ones
    (``found_id, x1..y2``) by IoU; ``iou`` at least ``least``."""

    def cost(p: list, q: list) -> np.ndarray:
        w = np.minimum(p[2][:, None], q[2][None]) - np.maximum(p[0][:, None], q[0][None])
        h = np.minimum(p[3][:, None], q[3][None]) - np.maximum(p[1][:, None], q[1][None])
        inner = np.maximum(w, 0) * np.maximum(h, 0)
        size = lambda d: (d[2] - d[0]) * (d[3] - d[1])
        union = size(p)[:, None] + size(q)[None] - inner
        return -np.where(union > 0, inner / np.where(union > 0, union, 1), 0.0)

    sides = ["x1", "y1", "x2", "y2"]
    out = greedy(truth, found, by, ["truth_id"], ["found_id"], sides, sides, cost, float(np.nextafter(-least, 0)), "truth_id", "found_id")
    return out.withColumn("iou", -F.col("cost")).drop("cost")


def by_rank(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of one side with the i-th of the other, in order; rows
    without partner are left with nulls."""
    from pyspark.sql.window import Window

    a = left.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, "_k"], "left").drop("_k")


def page_scores(truth: DataFrame, found: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Per page recall, precision, mean IoU, missed and false boxes; a side
    without boxes scores 1."""
    n = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("expected")).join(found.groupBy(*by).agg(F.count(F.lit(1)).alias("detected")), by, "full")
    m = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("mean_iou"))
    out = n.join(m, by, "left").fillna(0, ["expected", "detected", "matched"]).fillna(0.0, ["mean_iou"])
    ratio = lambda c: F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("matched"), F.col(c)))
    return out.withColumns({"recall": ratio("expected"), "precision": ratio("detected"), "missed": F.col("expected") - F.col("matched"), "false": F.col("detected") - F.col("matched")})
