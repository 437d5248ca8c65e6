"""Ordered state: islands, carried values, running identifiers, folds.

What a window can say is a window.  What compares with state that a window
can't hold (the first element of the current cluster) is a streaming fold: rows
are sorted within hash partitions and read once, so a key of any size needs the
memory of one state."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def chained(df: DataFrame, by: list[str], value: str, tolerance: float, ties: list[str] | None = None, name: str = "cluster") -> DataFrame:
    """Clusters of sorted values: a new one where the step from the previous
    value exceeds the tolerance; numbered from 1."""
    order = Window.partitionBy(*by).orderBy(value, *(ties or []))
    step = F.col(value) - F.lag(value).over(order)
    return df.withColumn("_new", F.when(step > tolerance, 1).otherwise(0)).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def parts(df: DataFrame, rows: int = 250_000) -> int:
    """Partitions for a shuffle of ``df`` by key: one per 250,000 rows, and as
    many as the session runs at once.  A task's sorts then hold as much on a
    large input as on a small one.  The rows are counted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def _partitioned(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*map(F.col, by)).sortWithinPartitions(*by, *order)


def by_group(df: DataFrame, by: list[str], order: list[str], values: list[str], make: Callable, schema: str) -> DataFrame:
    """``make(key, arrays)`` for each group: its ``values`` columns (numbers) as
    numpy arrays in order; it returns rows without the key.  Null keys are keys
    like any other.  Groups are bounded by nature (a page); they are cut from
    sorted partitions without a frame per group, which for small groups costs a
    hundredth of a grouped apply.  A group that goes on over several batches is
    put together once."""
    out = T.StructType.fromDDL(schema)
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(n, k) for n, k in zip(names, arrow)])
        open_key, open_parts = None, []

        def rows() -> list[tuple]:
            columns = [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*open_parts)]
            return [(*open_key, *r) for r in make(open_key, columns)] if open_parts else []

        for part in batches:
            keys = list(zip(*(part.column(k).to_pylist() for k in range(len(by)))))
            columns = [part.column(len(by) + k).to_numpy(zero_copy_only=False) for k in range(len(values))]
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
            made: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:]):
                if keys[a] != open_key:
                    made += rows()
                    open_key, open_parts = keys[a], []
                open_parts.append([c[a:b] for c in columns])
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in made], schema=kinds)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows()], schema=kinds)

    arrow = [to_arrow_type(f.dataType) for f in out.fields]
    needed = [*map(F.col, by), *[F.col(v).alias(f"_v{k}") for k, v in enumerate(values)]]
    return _partitioned(df, by, order).select(*needed).mapInArrow(run, out)


def anchored(df: DataFrame, by: list[str], value: str, tolerance: float, ties: list[str] | None = None, name: str = "cluster") -> DataFrame:
    """Clusters of sorted values: a new one where a value is further than the
    tolerance from the first of the current cluster; numbered from 1.  Null
    keys are keys like any other; null values belong to no cluster.

    Within a batch each cluster's end is found by bisection, so Python steps
    once per cluster; between batches only the open cluster is remembered."""
    schema = df.schema.add(name, "long")
    at = [df.columns.index(c) for c in by]
    value_at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n = None, None, 0
        for part in batches:
            keys = list(zip(*(part.column(k).to_pylist() for k in at)))
            column = part.column(value_at)
            values = column.to_pylist()
            known = np.array([v is not None and v == v for v in values], bool)
            made: list[int | None] = [None] * len(values)
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
            for a, b in zip(starts[:-1], starts[1:]):
                if keys[a] != key:
                    key, first, n = keys[a], None, 0
                i = a + int((~known[a:b]).sum())  # nulls sort first
                while i < b:
                    if first is None or values[i] - first > tolerance:
                        first, n = values[i], n + 1
                    j = bisect_right(values, tolerance, i, b, key=lambda v: v - first)
                    made[i:j] = [n] * (j - i)
                    i = j
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.int64())], schema=part.schema.append(pa.field(name, pa.int64())))

    return _partitioned(df, by, [value, *(ties or [])]).mapInArrow(run, schema)


def carried_forward(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last non-null value up to and including each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_ids(pages: DataFrame, by: list[str], order: list[str], count: str, detected: str, name: str = "start_id") -> DataFrame:
    """The identifier each page starts numbering from: one past the largest
    detected so far or the running count, whichever is ahead.  Closed form of
    the recurrence: structures before the page plus the largest lead."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        pages.withColumn("_s", F.coalesce(F.sum(count).over(before), F.lit(0)))
        .withColumn("_lead", F.col(detected) + 1 - F.sum(count).over(upto))
        .withColumn(name, F.col("_s") + F.greatest(F.lit(1), F.coalesce(F.max("_lead").over(before), F.lit(1))))
        .drop("_s", "_lead")
    )


def positional_ids(df: DataFrame, by: list[str], order: list[str], eligible: Column, name: str = "position") -> DataFrame:
    """Running numbers of the eligible rows of each document, null elsewhere."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.when(eligible, F.count(F.when(eligible, 1)).over(w)))


def reading_order(boxes: DataFrame, by: list[str], tolerance: float = 50, start: int = 1) -> DataFrame:
    """``boxes`` (x1, y1) numbered by rows chained in y, then x."""
    rows = chained(boxes, by, "y1", tolerance, ["x1"], "row")
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("row", "x1", "y1")) + (start - 1))


def column_edges(boxes: DataFrame, by: list[str], gap: float = 200) -> DataFrame:
    """Left edge of each column of boxes: distinct x1 chained by the gap."""
    return chained(boxes.select(*by, "x1").distinct(), by, "x1", gap).groupBy(*by, "cluster").agg(F.min("x1").alias("column_x"))


def merged_boundaries(lines: DataFrame, by: list[str], value: str = "at", tolerance: float = 15) -> DataFrame:
    """Chained positions as the whole part of their mean."""
    return chained(lines, by, value, tolerance, name="_c").groupBy(*by, "_c").agg(F.floor(F.sum(value) / F.count(F.lit(1))).alias(value)).drop("_c")


def merged_segments(bounds: list[int], least: int) -> list[int]:
    """Boundaries of one page with segments below a height merged forward."""
    out = bounds[:1]
    for b in bounds[1:-1]:
        if b - out[-1] >= least:
            out.append(b)
    return out + bounds[-1:] if len(bounds) > 1 else out


def split_header(words: DataFrame, by: list[str], gap: float = 50, running: bool = True) -> DataFrame:
    """Header words (x, w, text) joined into columns: a new column where a
    word starts more than the gap past the right edge so far (``running``) or
    past the previous word's."""
    order = Window.partitionBy(*by).orderBy("x", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max(F.col("x") + F.col("w")).over(before) if running else F.lag(F.col("x") + F.col("w")).over(order)
    cut = words.withColumn("_new", F.when(F.col("x") - edge > gap, 1).otherwise(0)).withColumn("column_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda s: s["text"]), " ")
    return cut.groupBy(*by, "column_no").agg(joined.alias("name"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right"))


def inside_limits(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows whose value isn't an outlier: with five or more, those up to
    q3 + 1.5 (q3 - q1) (q3 + 50 if that is 0), or in a run of three or more
    distinct values above it with steps of at most 2.  Quartiles are the
    elements n // 4 and 3 n // 4 of the sorted values; null values pass."""
    order = Window.partitionBy(*by).orderBy(value)
    everything = Window.partitionBy(*by)
    valued = df.where(F.col(value).isNotNull())
    ranked = valued.select(*by, value).withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(everything))
    limits = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 4), F.col(value))).alias("_q1"), F.max(F.when(F.col("_k") == F.floor(3 * F.col("_n") / 4), F.col(value))).alias("_q3"), F.max("_n").alias("_n")
    )
    spread = F.col("_q3") - F.col("_q1")
    limits = limits.select(*by, F.when(F.col("_n") >= 5, F.when(spread <= 0, F.col("_q3") + 50).otherwise(F.col("_q3") + 1.5 * spread)).alias("_limit"))
    joined = df.join(limits, by, "left")
    above = chained(joined.where(F.col(value) > F.col("_limit")).select(*by, value).distinct(), by, value, 2, name="_run")
    runs = above.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*by, "_run"))).where("_size >= 3").select(*by, value, F.lit(True).alias("_safe"))
    keep = F.col("_limit").isNull() | F.col(value).isNull() | (F.col(value) <= F.col("_limit")) | F.coalesce("_safe", F.lit(False))
    return joined.join(runs, [*by, value], "left").where(keep).select(*df.columns)
