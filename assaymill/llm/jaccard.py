"""The similarity mode of :mod:`.simhash`: groups of texts whose word shingles
are similar, exactly.

Similarity is the Jaccard index of the sets of word shingles.  First come the
balls of :func:`.simhash.links`: texts whose fingerprints differ in 3 bits or
fewer are candidates, verified by their whole sets; the links that hold make
components.  Fingerprints of 64 bits can't carry a bound of 0.8 (such pairs
differ in some 7 bits and up to 13 in the test tables), so what the balls leave
apart follows, from prefixes: under one order of all shingles, two sets with an
index of t or more share one of the first n - ceil(t n) + 1 of their n shingles,
and more than one where their sizes are alike; pairs that share too few of those
keys can't be similar.  That loses no pair; only pairs across components are
made, and every candidate is then verified by its whole sets.

Any order is right.  Shingles that are frequent in a sample of texts come last
in it, so that common lines and passages aren't what pairs are looked for by.

Sets that are equal count once.  Keys that many sets share (large clusters of
near copies) are not paired out: their sets are compared with a few leaders of
the key.  What those leave apart meets by first common keys: behind the first
key that two sets share lie all others, so of similar sets the smaller has it
within the first ninth of its order (at 0.8).  Frequent shingles come last, so
few sets have one there, and only these are paired, across components of the
key so far.  Each set carries 64 marks, flipped once by each of its shingles:
two sets differ in at least as many shingles as marks, so most pairs that can't
be similar are never made.  That connects what all pairs would connect: pairs left out have
both ends in one component, or no key that can be their first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, q, row_tie, sieve, sifted, stored, text_of, tidy
from .components import components

SEED = simhash.SEED
SHINGLE = 5
SIMILARITY = 0.8
#: Sets on one key up to which all pairs are candidates.
PAIRWISE = 32
#: Sets of a larger key that all of its sets are compared with.
LEADERS = 2
#: Texts that the order of shingles is sampled from, and the shingles kept.
SAMPLE_TEXTS, SAMPLE_SHINGLES = 20_000, 200_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending, A-Z
    lower-cased; fewer words than a shingle count as one, as does no word."""
    return np.unique(simhash.hashes(text, shingle))


def signature(of: np.ndarray) -> int:
    """64 bits that name a set."""
    return xxhash.xxh64_intdigest(of.tobytes(), SEED)


def marks(of: np.ndarray) -> int:
    """64 bits, each the parity of how many hashes point to it: sets differ in
    at least as many hashes as their marks do in bits."""
    return int(np.bitwise_xor.reduce(np.uint64(1) << (of & np.uint64(63)), initial=np.uint64(0)))


def prefix(of: np.ndarray, least: Fraction, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a set's hashes the first ``n - ceil(least n) + 1``: rare ones before
    those in ``often`` (ascending), these by their counts, ties by value."""
    n = len(of) + 1 + (-least.numerator * len(of)) // least.denominator
    if not len(often):
        return of[:n]
    at = np.minimum(np.searchsorted(often, of), len(often) - 1)
    return of[np.argsort(np.where(often[at] == of, counts[at], 0), kind="stable")[:n]]


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that recur in a sample of the texts, and how often they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle).view(np.int64))], names=["hash"])

    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64(F.lit(SEED), "_am_text"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = some.select("_am_text").mapInArrow(tidy(run), "hash long").groupBy("hash").count().where("count > 2").orderBy(F.desc("count"), "hash").limit(SAMPLE_SHINGLES).toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("count").to_numpy()[order]


def _sets(rows: DataFrame, shingle: int, least: Fraction, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``_am_id, _am_tie``, the set's ``_am_fp``, size ``n`` and ``marks``, its
    prefix ``keys`` and the text's fingerprint ``print`` for ``_am_id, _am_tie,
    _am_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, bits, prints, keys = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64), []
            for k, text in enumerate(batch.column(2)):
                every = simhash.hashes(text.as_py(), shingle)
                of, prints[k] = np.unique(every), simhash.folded(every)
                names[k], sizes[k], bits[k] = signature(of), len(of), marks(of)
                keys.append(prefix(of, least, often, counts).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names.view(np.int64)), pa.array(sizes), pa.array(bits.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(prints.view(np.int64))], names=["_am_id", "_am_tie", "_am_fp", "n", "marks", "keys", "print"])

    return rows.mapInArrow(tidy(run), f"_am_id {rows.schema['_am_id'].dataType.simpleString()}, _am_tie long, _am_fp long, n long, marks long, keys array<long>, print long")


def _whole(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes``: the whole set of each of ``_am_id, _am_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                of = shingles(text.as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([signature(of)], pa.uint64()).view(pa.int64()), pa.array([of.view(np.int64)], pa.list_(pa.int64()))], names=["node", "hashes"])

    return rows.mapInArrow(tidy(run), "node long, hashes array<long>")


def near(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs of the sets ``_am_fp`` of ``sets``, enough to connect all
    that have texts whose fingerprints ``print`` differ in 3 bits or fewer."""
    prints = stored(sets.select("print", "_am_fp").distinct())
    heads = stored(prints.groupBy("print").agg(F.min("_am_fp").alias("head")))
    met = simhash.links(heads.select(F.col("print").alias("_am_fp")))
    for end in ("a", "b"):
        met = met.join(heads.select(F.col("print").alias(end), F.col("head").alias(f"head_{end}")), end)
    same = prints.join(heads, "print").select(F.col("head").alias("a"), F.col("_am_fp").alias("b"))
    return same.unionByName(met.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))).where("a <> b")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Those of ``pairs (a, b)`` of ``sets`` that are similar, by their whole sets."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_am_fp")).distinct()
    # one text for each set that is compared
    ids = sets.join(wanted, "_am_fp", "left_semi").groupBy("_am_fp").agg(F.min(F.struct(F.col("_am_id").isNull(), "_am_id", "_am_tie")).alias("of"))
    ids = stored(ids.select(F.col("of._am_id").alias("_am_of"), F.col("of._am_tie").alias("_am_with")))
    some = sifted(texts, sieve(ids, F.col("_am_of"), F.col("_am_with")), F.col("_am_id"), F.col("_am_tie")).where("_am_maybe")
    whole = stored(_whole(some.select("_am_id", "_am_text"), shingle).dropDuplicates(["node"]))
    one = pairs.join(whole.withColumnsRenamed({"node": "a", "hashes": "of_a"}), "a")
    both = one.join(whole.withColumnsRenamed({"node": "b", "hashes": "of_b"}), "b")
    both = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return stored(both.where(F.col("common") * least.denominator >= (F.col("sum") - F.col("common")) * least.numerator).select("a", "b"))


def links(sets: DataFrame, texts: DataFrame, shingle: int, least: Fraction, pairwise: int = PAIRWISE) -> DataFrame:
    """``a, b``: links between the sets ``_am_fp`` of ``sets``, enough to
    connect all whose similarity is ``least`` or more.  ``texts`` has the
    ``_am_id, _am_tie, _am_text`` that the sets are of."""
    check = lambda pairs: verified(pairs, sets, texts, shingle, least)
    close = check(near(sets))
    return close.unionByName(rest(sets, close, check, least, pairwise))


def rest(sets: DataFrame, close: DataFrame, check: Callable[[DataFrame], DataFrame], least: Fraction, pairwise: int) -> DataFrame:
    """Links that ``check`` lets pass between the components of the links
    ``close (a, b)``, enough to connect all sets whose similarity is ``least``
    or more, by common prefix keys."""
    placed = cut(components(close)).withColumnRenamed("component", "placed")
    exploded = sets.select("_am_fp", "n", "marks", "keys", F.posexplode("keys").alias("pos", "key")).withColumn("prev", F.get("keys", F.col("pos") - 1)).drop("keys")
    often = stored(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    shared = sifted(exploded, sieve(often, F.col("key")), F.col("key")).where("_am_maybe").drop("_am_maybe")
    shared = shared.join(often, "key").select("key", F.col("_am_fp").alias("a"), "n", "marks", "pos", "prev", "sets").distinct()
    shared = stored(shared.join(placed, F.col("a") == F.col("node"), "left").withColumn("part", F.coalesce("placed", "a")).drop("node", "placed"))

    # a pair's sets have at most this in common, given the places of one common key in the order
    most = F.least("pos", "at") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    can_be = (F.least("n", "m") * least.denominator >= F.greatest("n", "m") * least.numerator) & (most * (least.numerator + least.denominator) >= (F.col("n") + F.col("m")) * least.numerator)
    differ = F.bit_count(F.col("marks").bitwiseXOR(F.col("notes")))
    can_be &= (F.col("n") + F.col("m") - differ) * (least.numerator + least.denominator) >= 2 * (F.col("n") + F.col("m")) * least.numerator
    as_other = {"a": "b", "n": "m", "marks": "notes", "pos": "at", "prev": "before", "part": "other"}
    low_high = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    few = shared.where(F.col("sets") <= pairwise).drop("sets")
    crowded = stored(shared.where(F.col("sets") > pairwise).drop("sets"))
    # similar sets have ``both`` shingles in common, and of those at most ``after`` lie behind the prefix that
    # ends first; the others are keys of both
    both = F.ceil((F.col("n") + F.col("m")) * least.numerator / (least.numerator + least.denominator))
    after = F.ceil(F.greatest("n", "m") * least.numerator / least.denominator) - 1
    sizes = [F.first("n").alias("n"), F.first("m").alias("m")]
    met = few.join(few.withColumnsRenamed(as_other), "key").where("a < b and part <> other").where(can_be).groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"), *sizes)
    if crowded.isEmpty():
        return check(met.where(F.col("keys") >= both - after).select("a", "b"))
    met = stored(met)
    lead = [F.min_by(F.struct(F.col("a").alias("b"), F.col("n").alias("m"), F.col("marks").alias("notes"), F.col("pos").alias("at"), F.col("part").alias("other")), F.xxhash64(F.lit(k), "key", "a")) for k in range(LEADERS)]
    leaders = stored(crowded.groupBy("key").agg(F.array(*lead).alias("lead")).select("key", F.inline("lead")))
    led = crowded.join(leaders, "key").where("part <> other").where(can_be).select(*low_high, F.lit(0).cast("long").alias("keys"), "n", "m")
    # here crowded keys aren't counted; a pair shares at most as many of them as either set has
    uncounted = stored(crowded.groupBy("a").agg(F.count(F.lit(1)).alias("more")))
    known = met.select("a", "b", "keys", "n", "m").unionByName(led).groupBy("a", "b").agg(F.sum("keys").alias("keys"), *sizes)

    def enough(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs (a, b, n, m, keys)`` that may share as many keys as similar sets must."""
        pairs = pairs.join(uncounted, "a", "left").join(uncounted.withColumnsRenamed({"a": "b", "more": "most"}), "b", "left")
        return pairs.where(F.coalesce("keys", F.lit(0)) + F.least(F.coalesce("more", F.lit(0)), F.coalesce("most", F.lit(0))) >= both - after).select("a", "b")

    found = check(enough(known))
    parts = cut(components(close.unionByName(found)))
    placed = stored(crowded.drop("part").join(parts, F.col("a") == F.col("node"), "left").select("key", "a", "n", "marks", "pos", "prev", F.coalesce("component", "a").alias("part")))
    main = placed.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    crowd = stored(placed.join(stored(main), "key").withColumn("out", F.col("part") != F.col("main")).drop("main"))
    # a pair's first common key and what lies behind it hold all they have in common: it is early in the smaller set
    early = crowd.where(F.col("n") - F.col("pos") >= F.ceil(2 * F.col("n") * least.numerator / (least.numerator + least.denominator)))
    others = crowd.withColumnsRenamed(as_other | {"out": "apart"})
    first = (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= both) & ~F.coalesce(F.col("prev") == F.col("before"), F.lit(False))

    def across(some: DataFrame, with_: DataFrame) -> DataFrame:
        return some.join(with_, "key").where("part <> other and n <= m").where(can_be & first).select(*low_high, "n", "m")

    # of two components at most one is the main one of a key
    late = across(early.where("out"), others).unionByName(across(early.where("not out"), others.where("apart")))
    late = late.groupBy("a", "b").agg(*sizes).join(met.select("a", "b", "keys"), ["a", "b"], "left")
    return found.unionByName(check(enough(late)))


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, pairwise: int = PAIRWISE) -> DataFrame:
    """``_am_id, _am_tie, _am_part`` for every row of ``docs``: the group of
    texts connected by a Jaccard index of ``similarity`` or more of their sets
    of word shingles.

    Null and empty texts equal each other.  Rows that repeat an id each get a
    row.  Empty input: empty output.  Other columns play no part.  Shingles and
    sets are told apart by 64-bit hashes."""
    least = Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    texts = docs.select(q(id_col).alias("_am_id"), row_tie(text_col).alias("_am_tie"), text_of(text_col).cast("binary").alias("_am_text"))
    sets = stored(_sets(texts, shingle, least, *_frequent(texts, shingle)))
    parts = stored(components(links(sets, texts, shingle, least, pairwise)))
    joined = sets.select("_am_id", "_am_tie", "_am_fp").join(parts, F.col("_am_fp") == F.col("node"), "left")
    return joined.select("_am_id", "_am_tie", F.coalesce("component", "_am_fp").alias("_am_part"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, pairwise: int = PAIRWISE) -> DataFrame:
    """``id_col, component_id`` for every row of ``docs``: the smallest id of
    its group (see :func:`members`); null ids are never smallest while another
    is there."""
    rows = stored(members(docs, id_col, text_col, shingle, similarity, pairwise))
    least = stored(rows.groupBy("_am_part").agg(F.min("_am_id").alias("component_id")))
    return rows.join(least, "_am_part").select(F.col("_am_id").alias(id_col), "component_id")
