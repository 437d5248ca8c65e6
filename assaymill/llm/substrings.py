"""Substring deduplication over difference-cover anchors.

Of every text, short windows are hashed only where the position modulo 13 lies
in a difference cover.  For any two positions some shift below 13 puts both on
the cover, so two equal windows of 20 words always share an aligned anchor of 8
words at equal distance from their starts.  Anchors that occur once end there.
Around the others the match is extended: every 20-word window holding a
repeated anchor is hashed in 96 bits, and windows with equal words are compared
by place; all but the first are repeats.

Before each shuffle a task reduces its own rows: of equal anchors (or windows)
seen together only the first travels under its hash, the others are known to be
repeated and travel under hashes of their own place.  A passage that a third of
all documents share thus costs one row per batch under its hash.  Texts are
shuffled only for documents that hold a repeated anchor; where those are few
enough, their counted ids are broadcast to drop the other texts first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import q, sieve, sifted, stored, text_of

#: A perfect difference set: every residue modulo 13 is a difference of two.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
#: Words hashed together in a task.
BATCH_WORDS = 500_000
_NO_ID = (1 << 63) - 1
_M = 0x9E3779B97F4A7C15


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Murmur's finaliser: spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` items: sums of item hashes times
    powers of an odd number, put together from windows of powers of two."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, size, part = None, 0, 1, h
    while True:
        if width & size:
            power = np.uint64(pow(_M, done, 1 << 64))
            piece = part[done : done + n] * power
            out = piece if out is None else out + piece
            done += size
        if done == width:
            return mixed(out)
        power = np.uint64(pow(_M, size, 1 << 64))
        part = part[:-size] + part[size:] * power
        size *= 2


def _batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_WORDS) -> Iterator[tuple[list, list[list[bytes]], list]]:
    """Rows as (ids, words, other column) of some ``most`` words together."""
    ids, texts, more, n = [], [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            part = whole.slice(at, 64)
            for k, text in enumerate(part.column(1)):
                words = (text.as_py() or b"").split()
                ids.append(part.column(0)[k].as_py())
                texts.append(words)
                more.append(part.column(2)[k].values.to_numpy(zero_copy_only=False) if whole.num_columns > 2 and part.column(2)[k].is_valid else None)
                n += len(words)
                if n >= most:
                    yield ids, texts, more
                    ids, texts, more, n = [], [], [], 0
    if ids:
        yield ids, texts, more


def _together(texts: list[list[bytes]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and where each text starts."""
    return word_hashes([w for words in texts for w in words], seed), np.cumsum([0, *map(len, texts)])


def _inside(starts: np.ndarray, width: int) -> np.ndarray:
    """Marks the places in the joint array at which a window of ``width`` lies
    inside one text."""
    ok = np.ones(int(starts[-1]), bool)
    for end in starts[1:]:
        ok[max(0, end - width + 1) : end] = False
    return ok


def _own_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(doc.astype(np.uint64) * np.uint64(_M) + at.astype(np.uint64) + np.uint64(1))


def anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``hash, doc, at`` of the anchors of (id, text) rows; the place is doubled,
    and odd where the anchor is known to be repeated."""
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for ids, texts, _ in _batches(batches):
        h, starts = _together(texts, 0)
        if len(h) < width:
            continue
        lengths = np.diff(starts)
        text = np.repeat(np.arange(len(ids)), lengths)
        at = np.arange(len(h)) - starts[text]
        ok = _inside(starts, width) & cover[at % PERIOD] & (lengths[text] >= window)
        where = np.flatnonzero(ok)
        if not len(where):
            continue
        key = window_hashes(h, width)[where]
        doc, at = np.array(ids, np.int64)[text[where]], at[where].astype(np.int32)
        _, first, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        known = count[group] > 1
        later = np.ones(len(key), bool)
        later[first] = False
        key = np.where(later, _own_key(doc, at), key)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(2 * at + known, pa.int32())], names=["hash", "doc", "at"])


def candidate_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``hash, hash2, doc, at, run`` of the windows holding one of the anchors
    listed in the third column: 96 bits of hash and the place.  Windows known to
    be repeats come as runs of ``run`` starts; others have ``run`` 0."""
    for ids, texts, listed in _batches(batches):
        h, starts = _together(texts, 0)
        if len(h) < window:
            continue
        n = len(h) - window + 1
        near = np.zeros(len(h) + 1, np.int64)
        for k, at in enumerate(listed):
            if at is None or len(at) == 0:
                continue
            at = at[at < starts[k + 1] - starts[k]].astype(np.int64) + starts[k]
            np.add.at(near, np.maximum(at - (PERIOD - 1), starts[k]), 1)
            np.add.at(near, at + 1, -1)
        where = np.flatnonzero((np.cumsum(near)[:-1] > 0) & _inside(starts, window))
        where = where[where < n]
        if not len(where):
            continue
        h2, _ = _together(texts, 1)
        key, key2 = window_hashes(h, window)[where], window_hashes(h2, window)[where]
        text = np.searchsorted(starts, where, side="right") - 1
        doc, at = np.array(ids, np.int64)[text], where - starts[text]
        order = np.lexsort((at, doc, key2, key))
        k1, k2, d, a = key[order], key2[order], doc[order], at[order]
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeated = (d != d[least]) | (a != a[least])
        # of rows at the least place itself (an id given twice) one travels
        seen = ~repeated & ~new
        lead = ~repeated & ~seen
        rows = [(k1[lead], k2[lead], d[lead], a[lead], np.zeros(lead.sum()))]
        if repeated.any():
            d, a = d[repeated], a[repeated]
            order = np.lexsort((a, d))
            d, a = d[order], a[order]
            head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] > a[:-1] + 1)])
            tail = np.r_[head[1:] - 1, len(d) - 1]
            own = _own_key(d[head], a[head])
            rows.append((own, own, d[head], a[head], a[tail] - a[head] + 1))
        for key, key2, doc, at, run in rows:
            short = (key2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(short), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(run.astype(np.int32))], names=["hash", "hash2", "doc", "at", "run"])


def _marked(n: int, runs: np.ndarray | None, window: int) -> np.ndarray:
    """Which of ``n`` words the repeated windows cover; a run is its first start
    shifted left by 32, and its length."""
    edge = np.zeros(n + 1, np.int64)
    if runs is not None and len(runs):
        start = np.minimum(runs >> 32, n)
        np.add.at(edge, start, 1)
        np.add.at(edge, np.minimum(start + (runs & 0xFFFFFFFF) + window - 1, n), -1)
    return np.cumsum(edge)[:-1] > 0


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, listed in _batches(batches):
            total, gone, digest, kept = [], [], [], []
            for words, runs in zip(texts, listed):
                stay = words
                if runs is not None and len(runs):
                    drop = _marked(len(words), runs, window)
                    stay = [w for w, d in zip(words, drop.tolist()) if not d]
                text = b" ".join(stay)
                total.append(len(words))
                gone.append(len(words) - len(stay))
                digest.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode("utf-8", "replace"))
            out = [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _of_listed(docs: DataFrame, listed: DataFrame, by: DataFrame, column: str) -> DataFrame:
    """(doc, text, ``column``) of the documents in ``listed``; other texts, as
    far as the sieve ``by`` tells them, go before the shuffle."""
    some = sifted(docs, by, F.col("doc")).where("_am_maybe")
    return some.join(listed, "doc", "left").select("doc", "text", column)


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, runs``: for each document of ``docs (doc, text)`` the repeated
    windows as runs (first start << 32 | number of starts)."""
    found = docs.mapInArrow(lambda b: anchors(b, window), "hash long, doc long, at int")
    again = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hash"))).where("at % 2 = 1 or n > 1")
    listed = stored(again.groupBy("doc").agg(F.collect_set(F.shiftright("at", 1)).alias("at")))
    some = _of_listed(docs, listed, sieve(listed, F.col("doc")), "at").where("at is not null")
    made = some.mapInArrow(lambda b: candidate_windows(b, window), "hash long, hash2 int, doc long, at int, run int")
    place = F.struct("doc", "at")
    least = F.min(place).over(Window.partitionBy("hash", "hash2"))
    gone = made.withColumn("first", least).where((F.col("run") > 0) | (place != F.col("first")))
    packed = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.greatest(F.lit(1), F.col("run")).cast("long"))
    return gone.groupBy("doc").agg(F.collect_set(packed).alias("runs"))


def _key(id_col: str) -> Column:
    return F.coalesce(q(id_col).cast("long"), F.lit(_NO_ID))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` (and ``kept_text``) for every
    row of ``docs``: words covered by a window of ``window`` words whose word
    sequence also starts earlier (smaller id, or the same document) are removed.
    Windows are judged on the input.  ``window`` is at least the period, 13.

    Null texts have no words.  Rows that repeat an id count as one place: equal
    texts under one id don't repeat each other.  Null ids come last and are one
    document.  Texts shorter than a window are kept.  Empty input: empty
    output.  Other columns play no part."""
    if window < PERIOD:
        raise ValueError(f"windows of fewer than {PERIOD} words have no anchor")
    rows = docs.select(_key(id_col).alias("doc"), text_of(text_col).cast("binary").alias("text"))
    runs = stored(repeated_runs(rows, window))
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    by = sieve(runs, F.col("doc"))
    clear = sifted(rows, by, F.col("doc")).where(~F.col("_am_maybe")).select("doc", "text", F.lit(None).cast("array<long>").alias("runs"))
    out = _of_listed(rows, runs, by, "runs").mapInArrow(_kept(window, with_text), schema).unionByName(clear.mapInArrow(_kept(window, with_text), schema))
    kind = docs.schema[id_col].dataType
    names = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    return out.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).cast(kind).alias(id_col), *names)
