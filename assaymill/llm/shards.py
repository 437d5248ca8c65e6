"""Uniform shuffle into shards of exact sizes by a hypergeometric
communication matrix.

Rows are dealt into virtual partitions by a hash of their key; the driver draws
how many rows of each partition go to each shard (a multivariate hypergeometric
sample, so the joint law is that of a uniform permutation), each partition
permutes its rows and deals them out by those counts, and each shard permutes
what it got.  Only counts reach the driver: at most ``MAX_PARTITIONS`` rows by
``n_shards`` columns.  The second permutation works in slices of a shard with
offsets from counted slices, so no task holds a whole shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import carried, q, unit_hash

ROWS_PER_PARTITION = 10_000
#: Bound of what the driver holds and broadcasts: 20,000 x shards counts.
MAX_PARTITIONS = 20_000
_MADE = ["shard", "slot", "_am_part", "_am_order", "_am_tie", "_am_rank", "_am_cuts", "_am_slice", "_am_from"]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw; above numpy's population limit by inversion of the
    probabilities within 40 standard deviations of the mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, ((n + 1) * (good + 1)) // (good + bad + 2)))
    reach = int(40 * (n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1])])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """``out[p, s]``: rows of partition ``p`` that go to shard ``s``; row sums
    are ``counts``, column sums ``sizes``."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, count in enumerate(counts):
        rest, need = sum(left), count
        for s in range(len(left)):
            if need == 0:
                break
            take = need if rest == left[s] else hypergeometric(rng, left[s], rest - left[s], need)
            rest -= left[s]
            left[s] -= take
            need -= take
            out[p, s] = take
    return out


def uniform_shards(df: DataFrame, key: str = "doc_id", n_shards: int = 40, seed: int = 20240, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards-1, counts at most one apart) and
    ``slot`` (gapless from 0 in each shard).

    A function of the rows and the seed alone: reruns and retried tasks agree.
    Null keys are a value like any other.  Rows that repeat a key are told apart
    by a hash of the whole row; wholly equal rows are interchangeable.  Fewer
    rows than shards leave shards empty; empty input gives empty output.  Input
    columns named like the result's are replaced."""
    spark = df.sparkSession
    names = carried(df, [m for m in _MADE if m.lower() != key.lower()])
    rows = df.select(*map(q, names))
    n = rows.count()
    parts = max(1, min(MAX_PARTITIONS, -(-n // rows_per_partition)))
    slices = max(1, min(MAX_PARTITIONS // max(1, min(n_shards, 1000)), -(-n // max(1, n_shards * rows_per_partition))))
    # maps can't be hashed; they don't take part in telling equal keys apart
    flat = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = rows.withColumn("_am_part", (unit_hash(q(key), seed=seed) * parts).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("_am_part").count().collect()}  # at most MAX_PARTITIONS rows
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    schema = T.StructType([T.StructField("_am_part", T.IntegerType()), T.StructField("_am_cuts", T.ArrayType(T.LongType()))])
    cuts = spark.createDataFrame([(p, [int(x) for x in row]) for p, row in enumerate(np.cumsum(matrix, axis=1)[:, :-1])], schema)
    local = Window.partitionBy("_am_part").orderBy("_am_order", "_am_tie")
    dealt = (
        rows.withColumn("_am_order", unit_hash(q(key), seed=seed + 1))
        .withColumn("_am_tie", F.xxhash64(*map(q, flat)) if flat else F.lit(0))
        .withColumn("_am_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "_am_part")  # at most MAX_PARTITIONS rows of n_shards counts
        .withColumn("shard", F.size(F.filter("_am_cuts", lambda c: c <= F.col("_am_rank"))))
        .withColumn("_am_order", unit_hash(q(key), seed=seed + 2))
        .withColumn("_am_slice", (F.col("_am_order") * slices).cast("int"))
    )
    per = {(r[0], r[1]): r[2] for r in dealt.groupBy("shard", "_am_slice").count().collect()}  # n_shards x slices rows
    starts, at = [], 0
    for s in range(n_shards):
        at = 0
        for k in range(slices):
            starts.append((s, k, at))
            at += per.get((s, k), 0)
    offsets = spark.createDataFrame(starts, "shard int, _am_slice int, _am_from long")
    again = Window.partitionBy("shard", "_am_slice").orderBy("_am_order", "_am_tie")
    return (
        dealt.withColumn("_am_rank", F.row_number().over(again) - 1)
        .join(F.broadcast(offsets), ["shard", "_am_slice"])  # at most MAX_PARTITIONS rows
        .withColumn("slot", F.col("_am_from") + F.col("_am_rank"))
        .select(*map(q, names), "shard", F.col("slot").cast("long").alias("slot"))
    )
