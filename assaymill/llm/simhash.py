"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Fingerprints are reduced to distinct ones first.  Each emits the 64-bit variants
within half the radius: 3 is odd, so fingerprints with an even number of ones
emit their ball of radius 1 (65 variants) and odd ones that of radius 2.  Two
fingerprints at distance 1 or 2 meet at a variant within 1 of both.  At distance
3 their parities differ, and the odd one, two flips away, meets the even one's
ball of radius 1; of three differing bits two have places of like parity, so
flips at such pairs of places are enough (992 of 2,016).

All fingerprints at a variant that is within 1 of one of them are within the
radius of that one; each variant links them to the smallest such.  The links
grow with the number of variants that meet, not with the square of a cluster,
and connect what all pairs would connect.  A variant holds at most 1,057
distinct fingerprints, so no group of the shuffle is ever large.

Variants are taken in passes by their leading bits, so that one pass, not all of
them, lies on disk; a fingerprint emits in a pass just the variants that have
those bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, one_of_each, q, row_tie, stored, text_of, tidy
from .components import components

SEED = 42
RADIUS = 3
#: Passes over the variants: one for each value of so many leading bits.
PASS_BITS = 3


def hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 of a text's word shingles in order, A-Z lower-cased, repeats
    included; fewer words than a shingle count as one, as does no word."""
    words = text.lower().split()
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1))


def folded(of: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(of), 1 << 16):
        bits = np.unpackbits(of[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(of), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, A-Z lower-cased, repeats
    counted; fewer words than a shingle count as one, no word gives 0."""
    return folded(hashes(text, shingle)) if text.strip() else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``_am_id, _am_tie, _am_fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(2)):
                out[k] = fingerprint(text.as_py() or b"", shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["_am_id", "_am_tie", "_am_fp"])

    rows = docs.select(q(id_col).alias("_am_id"), row_tie(text_col).alias("_am_tie"), text_of(text_col).cast("binary").alias("_am_text"))
    return rows.mapInArrow(tidy(run), f"_am_id {rows.schema['_am_id'].dataType.simpleString()}, _am_tie long, _am_fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def masks(odd: bool, lead: int, bits: int = PASS_BITS) -> list[int]:
    """What a fingerprint of that parity is flipped by to give its variants
    whose leading bits differ from its own by ``lead``."""
    one = [0] + [1 << k for k in range(64)]
    two = [1 << j | 1 << k for k in range(64) for j in range(k % 2, k, 2)] if odd else []
    return [m for m in [*one, *two] if m >> (64 - bits) == lead]


def links(distinct: DataFrame, bits: int = PASS_BITS) -> DataFrame:
    """``a, b``: links between the fingerprints ``_am_fp`` (distinct longs),
    enough to connect all that are within 3 bits of each other."""
    lists = lambda odd: F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in masks(odd, lead, bits)]).cast("array<long>") for lead in range(1 << bits)])
    odd = F.bit_count("_am_fp") % 2 == 1
    within_one = F.bit_count(F.col("_am_fp").bitwiseXOR(F.col("variant"))) <= 1
    least = F.min(F.when(within_one, F.col("_am_fp"))).over(Window.partitionBy("variant"))
    found = None
    for lead in range(1 << bits):
        own = F.shiftrightunsigned("_am_fp", 64 - bits).bitwiseXOR(F.lit(lead)).cast("int") + 1
        flips = F.when(odd, F.element_at(lists(True), own)).otherwise(F.element_at(lists(False), own))
        spread = distinct.select("_am_fp", F.explode(F.transform(flips, lambda m: F.col("_am_fp").bitwiseXOR(m))).alias("variant"))
        some = stored(spread.withColumn("a", least).where("a <> _am_fp").select("a", F.col("_am_fp").alias("b")).distinct())
        found = some if found is None else found.unionByName(some)
        # lets Spark's cleaner drop the pass's shuffle before the next one
        distinct.sparkSession._jvm.System.gc()
    return found.distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``_am_id, _am_tie, _am_fp`` of every row, and ``_am_of, _am_part,
    component_id`` of every fingerprint."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    distinct = stored(rows.groupBy("_am_fp").agg(F.min("_am_id").alias("least")))
    parts = cut(components(links(distinct.select("_am_fp"))))
    joined = distinct.join(parts, F.col("_am_fp") == F.col("node"), "left").withColumn("_am_part", F.coalesce("component", "_am_fp"))
    joined = stored(joined.select(F.col("_am_fp").alias("_am_of"), "_am_part", "least"))
    named = joined.groupBy("_am_part").agg(F.min("least").alias("component_id"))
    return rows, stored(joined.drop("least").join(named, "_am_part"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``:
    16 lower-case hex digits, and the smallest id reachable over fingerprints
    that differ in 3 bits or fewer.

    Null and empty texts have fingerprint zero and are linked like any other.
    Null ids are never smallest while another is there.  Rows that repeat an id
    each get a row.  Empty input: empty output.  Other columns play no part."""
    rows, named = _grouped(docs, id_col, text_col, shingle)
    return rows.join(named, F.col("_am_fp") == F.col("_am_of")).select(
        F.col("_am_id").alias(id_col), F.lpad(F.lower(F.hex("_am_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def kept_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one, with their own
    columns: the smallest id, null last; of rows that repeat it one.

    Groups are those of :func:`simhash_groups`, or, given a ``similarity``, of
    texts whose sets of ``shingle`` words have a Jaccard index of that or more:
    the links of the balls are held against whole sets, and what no ball of
    fingerprints reaches at a bound like 0.8 (such pairs differ in some 10 of 64
    bits) is found by common shingles (:mod:`.jaccard`).

    Null and empty texts equal each other; empty input gives empty output."""
    if similarity is not None:
        from .jaccard import members

        return one_of_each(docs, id_col, text_col, members(docs, id_col, text_col, shingle, similarity))
    rows, named = _grouped(docs, id_col, text_col, shingle)
    return one_of_each(docs, id_col, text_col, rows.join(named, F.col("_am_fp") == F.col("_am_of")).select("_am_id", "_am_tie", "_am_part"))
