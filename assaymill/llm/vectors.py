"""Embedding near-dedup by product quantisation.

Equal vectors are one vector with a multiplicity.  Coarse k-means lists and
subspace codebooks of the residuals are fitted on a bounded sample; every vector
is assigned to its list and coded.  A vector probes those lists whose Voronoi
cell it is within the radius of (its distance to the bisector of the two
centroids), which no true neighbour escapes.  In a list, distances come from
asymmetric table lookup; a coded vector is a candidate when its lookup distance
is at most the radius plus its own coding error, which again loses none.
Candidates are verified by their exact cosine in double precision.

Lists are cut into tiles of bounded size on both sides, so a list with a third
of all vectors is many tasks.  A tile returns, per vector, the weight of its
links, and a spanning forest of the links in place of all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, q, stored
from .components import components

COSINE = 0.98
#: Vectors the quantisers are fitted on, at most.
SAMPLE = 20_000
TILE = 2_048
CODES = 256
SUBSPACE = 4


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(half - x[at : at + 4096] @ c.T, axis=1)
    return out


@dataclass
class Quantiser:
    """Coarse centroids, and one codebook per slice of the residual."""

    coarse: np.ndarray
    books: list[np.ndarray]
    slices: list[slice]

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and distance to the decoded vector."""
        lists = nearest(units, self.coarse)
        rest = units - self.coarse[lists]
        codes = np.empty((len(units), len(self.books)), np.uint8)
        off = np.zeros(len(units))
        for m, (book, part) in enumerate(zip(self.books, self.slices)):
            codes[:, m] = nearest(rest[:, part], book)
            off += ((rest[:, part] - book[codes[:, m]]) ** 2).sum(axis=1)
        return lists, codes, np.sqrt(off)

    def probes(self, units: np.ndarray, lists: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists from its own on whose cells reach within
        ``radius`` of the row's vector."""
        c = self.coarse
        to = np.maximum(0, (units * units).sum(axis=1)[:, None] - 2 * units @ c.T + (c * c).sum(axis=1))
        own = to[np.arange(len(units)), lists]
        apart = np.sqrt(np.maximum(0, ((c[:, None] - c[None]) ** 2).sum(axis=2)))[lists]
        bisector = (to - own[:, None]) / np.maximum(2 * apart, 1e-12)
        near = (bisector <= radius + 1e-9) & (np.arange(len(c)) >= lists[:, None])
        near[np.arange(len(units)), lists] = True
        return np.nonzero(near)

    def lookup(self, units: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of ``units`` to the coded vectors of a list."""
        rest = units - self.coarse[which]
        out = np.zeros((len(units), len(codes)))
        for m, (book, part) in enumerate(zip(self.books, self.slices)):
            r = rest[:, part]
            table = (r * r).sum(axis=1)[:, None] - 2 * r @ book.T + (book * book).sum(axis=1)
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def fit(units: np.ndarray, seed: int = 3) -> Quantiser:
    k = int(max(1, min(256, round(len(units) ** 0.5))))
    coarse = kmeans(units, k, 8, seed)
    rest = units - coarse[nearest(units, coarse)]
    d = units.shape[1]
    slices = [slice(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(d), max(1, d // SUBSPACE))]
    return Quantiser(coarse, [kmeans(rest[:, s], CODES, 6, seed + 1 + m) for m, s in enumerate(slices)], slices)


def units_of(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very small and large numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links among ``a``-``b`` enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _tile(quantiser: Quantiser, cosine: float):
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    schema = ["uid", "weight", "other"]

    def run(key, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"uid": np.empty(0, np.int64), "weight": np.empty(0, np.int64), "other": np.empty(0, np.int64)})
        if index.empty or asked.empty:
            return empty
        which = int(key[1])
        x = units_of(np.stack([np.frombuffer(v, np.float64) for v in index["v"]]))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in index["codes"]])
        reach = radius + index["off"].to_numpy() + 1e-7
        y = units_of(np.stack([np.frombuffer(v, np.float64) for v in asked["w"]]))
        ux, uy = index["uid"].to_numpy(), asked["asks"].to_numpy()
        own = asked["home"].to_numpy() == which
        wx, wy = index["mult"].to_numpy(), asked["times"].to_numpy()
        sum_x, sum_y = np.zeros(len(ux), np.int64), np.zeros(len(uy), np.int64)
        found: list[tuple[int, int]] = []
        for at in range(0, len(y), 256):
            close = quantiser.lookup(y[at : at + 256], which, codes) <= reach
            close &= ~own[at : at + 256, None] | (uy[at : at + 256, None] < ux)
            i, j = np.nonzero(close)
            keep = np.concatenate([(y[at + i[b : b + 65536]] * x[j[b : b + 65536]]).sum(axis=1) >= cosine for b in range(0, len(i), 65536)] or [np.empty(0, bool)])
            i, j = at + i[keep], j[keep]
            np.add.at(sum_y, i, wx[j])
            np.add.at(sum_x, j, wy[i])
            found += _forest(uy[i], ux[j])
        links = np.array(_forest(*np.array(found, np.int64).T), np.int64).reshape(-1, 2) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame(
            {
                "uid": np.r_[ux[sum_x > 0], uy[sum_y > 0], links[:, 0]],
                "weight": np.r_[sum_x[sum_x > 0], sum_y[sum_y > 0], np.zeros(len(links), np.int64)],
                "other": np.r_[np.full((sum_x > 0).sum() + (sum_y > 0).sum(), -1), links[:, 1]],
            }
        )[schema]

    return run


def _links(vectors: DataFrame, cosine: float, sample: int) -> DataFrame:
    """``uid, weight, other`` (see :func:`_tile`) among vectors of one length,
    ``uid, label, v, mult``."""
    spark = vectors.sparkSession
    rows = vectors.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("v").collect()
    quantiser = fit(units_of(np.array([r.v for r in rows], np.float64)))
    shared = spark.sparkContext.broadcast(quantiser)  # at most 256 lists and 256 codes of each subspace
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                raw = np.array(b.column(2).to_pylist(), np.float64)
                u = units_of(raw)
                lists, codes, off = shared.value.encode(u)
                row, to = shared.value.probes(u, lists, radius)
                bounds = np.searchsorted(row, np.arange(len(u) + 1))
                out = [b.column(0), b.column(1), pa.array([v.tobytes() for v in raw], pa.binary()), b.column(3), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(to.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out, names=["uid", "label", "v", "mult", "own", "codes", "off", "probes"])

    kind = vectors.schema["label"].dataType.simpleString()
    coded = stored(vectors.select("uid", "label", "v", "mult").mapInArrow(assign, f"uid long, label {kind}, v binary, mult long, own int, codes binary, off double, probes array<int>"))
    asked = coded.select("uid", "label", "v", "mult", "own", F.explode("probes").alias("list"))
    # tiles: blocks of both sides of each list, from its counts
    sizes = coded.groupBy("label", F.col("own").alias("list")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("bx"))
    asks = asked.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("by"))
    tiles = stored(sizes.join(asks, ["label", "list"]))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    index = coded.withColumnRenamed("own", "list").join(tiles, ["label", "list"]).select("label", "list", block("bx").alias("tx"), F.explode(F.expr("sequence(0, by - 1)")).alias("ty"), "uid", "v", "mult", "codes", "off")
    queries = asked.join(tiles, ["label", "list"]).select(
        F.col("label").alias("label_"), F.col("list").alias("list_"), F.explode(F.expr("sequence(0, bx - 1)")).alias("tx_"), block("by").alias("ty_"),
        F.col("uid").alias("asks"), F.col("v").alias("w"), F.col("mult").alias("times"), F.col("own").alias("home"),
    )
    keys = ["label", "list", "tx", "ty"]
    return index.groupBy(*keys).cogroup(queries.groupBy(*[k + "_" for k in keys])).applyInPandas(_tile(quantiser, cosine), "uid long, weight long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors of equal, non-null labels and equal length link when their cosine
    is at least ``cosine``.  Null, empty and zero vectors, and vectors with null
    or non-finite components, link with nothing and keep their own id.  Rows
    that repeat an id are vectors of their own, linked to each other when their
    vectors link.  Null ids are never smallest while another is there.  Empty
    input: empty output.  Other columns play no part."""
    v = q(vector_col).cast("array<double>")
    good = F.coalesce(
        q(label_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(q(id_col).alias("id"), F.when(good, v).alias("v"), q(label_col).alias("label"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "label", "v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "label", "v")))
    usable = rows.where("v is not null")
    # the two hashes are 128 bits of label and vector
    alike = usable.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    alike = stored(stored(alike).withColumn("uid", F.monotonically_increasing_id()))
    parts = [_links(alike.where(F.size("v") == r.n), cosine, sample) for r in alike.select(F.size("v").alias("n")).distinct().collect()]
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = stored(found)
    weights = found.groupBy("uid").agg(F.sum("weight").alias("weight"))
    joined = components(found.where("other >= 0").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = cut(
        alike.select("h1", "h2", "uid", "least", "mult")
        .join(weights, "uid", "left")
        .join(joined.withColumnRenamed("node", "uid"), "uid", "left")
        .select("h1", "h2", "least", (F.col("mult") - 1 + F.coalesce("weight", F.lit(0))).alias("n"), F.coalesce("component", "uid").alias("part"))
    )
    named = cut(named.join(named.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("h1", "h2", "n", "component_id"))
    return rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )
