"""Best-fit packing of token pieces by hierarchical residual packing.

Documents are tokenised once into pieces of at most a sequence's length; only
narrow piece records are packed.  Full pieces are sequences.  The others are
dealt into groups that best-fit their pieces locally, longest first.  Bins that
are nearly full are final; underfull bins go on as items: a fan-in of groups is
merged and best-fit again, round after round, until one group is left or a
round merges nothing.  Each round's record is stored in the shared folder."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q, stored, text_of, tidy

LENGTH = 2048
EOS = 0
ITEMS_PER_GROUP = 50_000
FAN_IN = 8
#: Bins at least so full are final at once.
NEARLY_FULL = 0.99
#: Bytes that one of the two generations of remembered pieces may take, about.
CACHE_BYTES = 48 << 20
_ENTRY_BYTES = 150
#: Bytes of text that numpy cuts at once.
SLAB = 2 << 20
#: ASCII marks that the tokenizer's pattern takes as one piece after letters.
#: An apostrophe may start a piece of its own kind, and so isn't among them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceTokens:
    """Ids of the pieces the tokenizer's pattern cuts lower-case text into.

    The normaliser and the pattern never join characters across white space, so
    a text's ids are those of its words in order.  A batch's words are cut with
    numpy: words of ASCII bytes into the pattern's own pieces (letters, single
    digits, marks, contractions), words with other bytes stay whole.  Arrow
    reduces the pieces to distinct ones; only those seen for the first time
    reach the tokenizer, many at once, and each ends with the one token that
    carries the end-of-word suffix.  Ids are then gathered by position.

    Two generations of pieces are kept, each of at most ``CACHE_BYTES``, so a
    worker's memory is bounded and frequent pieces stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def specials(self, text: np.ndarray) -> np.ndarray:
        """Ids of a text that may name special tokens."""
        return np.frombuffer(self.whole(text.tobytes().decode("utf-8", "replace")), "<u4")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the pattern leaves in one."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 1000):
            some = pieces[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist() if len(ids) else []
            if len(stop) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *stop], stop)]
            else:  # the normaliser made something else of one of them
                out += map(self.whole, some)
        return out

    def learn(self, new: list[bytes]) -> None:
        """Adds ``new`` (distinct, without white space) to what is known."""
        older, known = self.older, self.known
        again = [w for w in new if w in older]
        if again:
            known.update((w, older[w]) for w in again)
            self.held += sum(map(len, again)) + _ENTRY_BYTES * len(again)
            new = [w for w in new if w not in older]
        plain = [w for w in new if w.isascii()]
        known.update(zip(plain, self._encoded(b"\n".join(plain).decode().split("\n") if plain else [])))
        if len(plain) < len(new):
            other = [w for w in new if not w.isascii()]
            text = [w.decode("utf-8", "replace") for w in other]
            runs = [t.rstrip(_MARKS) for t in text]
            # lower-casing can add a mark to a letter; such words, and those of mixed kinds, go as they are
            easy = [k for k, r in enumerate(runs) if r.isalpha() and r.lower().isalpha()]
            letters = dict.fromkeys(runs[k] for k in easy)
            letters = dict(zip(letters, self._encoded(list(letters))))
            marks = dict.fromkeys(text[k][len(runs[k]) :] for k in easy)
            marks = {m: self.whole(m) if m else b"" for m in marks}
            known.update((other[k], letters[runs[k]] + marks[text[k][len(runs[k]) :]]) for k in easy)
            for k in set(range(len(other))).difference(easy):
                known[other[k]] = self.whole(text[k])
        self.held += sum(map(len, new)) + _ENTRY_BYTES * len(new)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray] | None:
        """The pieces of the texts, reduced to distinct ones, and how many there
        are before the end of each text; nothing if no text has a word."""
        kind = _KIND[data]
        ink = kind > 0
        first = np.zeros(len(data) + 1, bool)
        first[bounds[:-1]] = True
        first = first[:-1]
        # words, and which of them have bytes beyond ASCII
        word = ink & (first | np.r_[True, ~ink[:-1]])
        starts = np.flatnonzero(word).astype(np.int32)
        if not len(starts):
            return None
        foreign = np.logical_or.reduceat(data >= 128, starts)
        plain = np.repeat(~foreign, np.diff(starts, append=np.int32(len(data))))
        lead = len(data) - len(plain)
        plain = np.r_[np.zeros(lead, bool), plain] if lead else plain
        change = (kind != np.r_[kind[:1], kind[:-1]]) | (kind == 2)
        cut = word | (ink & plain & change)
        # contractions: a lone apostrophe and the letters after it that the pattern takes with it
        lone = np.flatnonzero(cut & plain & (data == 39))
        lone = lone[(lone + 1 < len(data))]
        lone = lone[cut[lone + 1] & (kind[lone + 1] == 1) & ~word[lone + 1]]
        for at in lone.tolist():
            tail = data[at + 1 : at + 3].tobytes().lower()
            n = 1 if tail[:1] in _ONE else 2 if tail in _TWO and ink[at + 2] and not first[at + 2] else 0
            if n:
                cut[at + 1] = False
                if at + 1 + n < len(data) and ink[at + 1 + n]:
                    cut[at + 1 + n] = True
        flat = _LOWER[data[ink]]
        where = np.flatnonzero(cut[ink]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(np.r_[where, np.int32(len(flat))]), pa.py_buffer(flat)]).dictionary_encode()
        return pieces, np.r_[np.int32(0), np.cumsum(cut, dtype=np.int32)][bounds[1:]]

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[bounds[k]:bounds[k + 1]]`` (bytes), and
        where each text's ids end."""
        if self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        found = self._cut(data, bounds)  # its arrays, as long as the text, are gone when the ids are gathered
        if found is None:
            return np.empty(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        pieces, before = found
        names = _bytes_of(pieces.dictionary)
        known = self.known
        new = [w for w in names if w not in known]
        if new:
            self.learn(new)
        parts = list(map(known.__getitem__, names))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        base = np.cumsum(size) - size
        code = pieces.indices.to_numpy()
        n = size[code]
        upto = np.cumsum(n)
        at = np.repeat(base[code] - (upto - n), n)
        at += np.arange(len(at))
        # ids before the end of each text
        return pool[at], np.r_[0, upto][before]


def _bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).tolist()
    raw = (column.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: 0 white space, 1 letter (or beyond ASCII), 2 digit, 3 mark; and
    its lower case."""
    kind = np.full(256, 3, np.uint8)
    kind[[*b" \t\n\r\x0b\x0c"]] = 0
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


_KIND, _LOWER = _kinds()
#: What the tokenizer's pattern takes together with an apostrophe before it.
_ONE, _TWO = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")


#: One per path for the life of a Python worker.
_KNOWN: dict[str, PieceTokens] = {}


def _slabs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, how many) of some ``SLAB`` bytes together."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    of = (np.cumsum(sizes) - sizes) // SLAB
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    return zip(heads.tolist(), np.diff(np.r_[heads, len(of)]).tolist())


def token_ids(texts: pa.Array, known: PieceTokens) -> Iterator[np.ndarray]:
    """Ids of every text (UTF-8).  A long text goes slab by slab, cut at white space."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    # special tokens are matched before lower-casing
    special = {int(np.searchsorted(bounds, m.start(), "right")) - 1 for m in re.finditer(rb"<\|", data)}
    if int(np.diff(bounds).max(initial=0)) <= 2 * SLAB:
        ids, upto = known.ids(data, bounds)
        upto = np.r_[0, upto]
        for k in range(len(texts)):
            yield ids[upto[k] : upto[k + 1]] if k not in special else known.specials(data[bounds[k] : bounds[k + 1]])
        return
    for k in range(len(texts)):
        text = data[bounds[k] : bounds[k + 1]]
        if k in special:
            yield known.specials(text)
            continue
        parts, at = [np.empty(0, "<u4")], 0
        while at < len(text):
            to = at + SLAB
            while to < len(text) and not (white := np.flatnonzero(_KIND[text[to : to + SLAB]] == 0)).size:
                to += SLAB
            to = to + int(white[0]) if to < len(text) else len(text)
            parts.append(known.ids(text[at:to], np.array([0, to - at]))[0])
            at = to
        yield np.concatenate(parts)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc, piece, start, length, ids_crc32`` and, on request, ``ids`` of the
    pieces of every document: its ids and the end id, cut every ``length``."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _KNOWN:
            _KNOWN[path] = PieceTokens(path)
        known = _KNOWN[path]
        end = np.array([EOS], "<u4")
        for batch in batches:
            for at, n in _slabs(batch.column(1)):
                row, piece, start, size, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(token_ids(batch.column(1).slice(at, n), known)):
                    ids = np.concatenate([ids, end])
                    for m, b in enumerate(range(0, len(ids), length)):
                        part = ids[b : b + length]
                        row.append(at + k)
                        piece.append(m)
                        start.append(b)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(q(id_col).alias("doc"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given: the one with the least room
    that still takes it, else a new one.  Rooms are bits of one integer, so the
    next fitting room is found by a shift."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins, out = 0, 0, []
    for size in sizes:
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, at = capacity, n_bins
            n_bins += 1
        left = room - size
        if left > 0:
            if not rooms[left]:
                mask |= 1 << left
            rooms[left].append(at)
        out.append(at)
    return out


def pack_group(part: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    """Best-fit of one group's items (``item``: its pieces share a number)."""
    order = ["item", "offset"]
    part = part.sort_values(order, kind="stable", ignore_index=True)
    item = part["item"].to_numpy()
    head = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    fill = np.add.reduceat(part["length"].to_numpy(), head)
    longest = np.lexsort((item[head], -fill))
    bins = np.empty(len(head), np.int64)
    bins[longest] = best_fit(fill[longest].tolist(), capacity)
    # items of a bin one after another, in the order they were placed
    place = np.lexsort((np.argsort(longest), bins))
    before = np.cumsum(fill[place]) - fill[place]
    first = np.r_[True, bins[place][1:] != bins[place][:-1]]
    base = np.maximum.accumulate(np.where(first, before, 0))
    at = np.empty(len(head), np.int64)
    at[place] = before - base
    of = np.cumsum(np.r_[True, item[1:] != item[:-1]]) - 1
    total = np.bincount(bins, weights=fill).astype(np.int64)
    part["offset"] = part["offset"].to_numpy() + at[of]
    part["item"] = (np.int64(level) << 56) + (part["grp"].to_numpy().astype(np.int64) << 32) + bins[of]
    part["fill"] = total[bins[of]]
    part["merged"] = np.bincount(bins, minlength=len(total))[bins[of]] > 1
    return part


def _packer(level: int, capacity: int, names: list[str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        if level == 1:  # every piece is an item, whatever order the shuffle delivered
            part = part.sort_values(["doc", "piece", "start"], kind="stable", ignore_index=True)
            part["item"] = np.arange(len(part), dtype=np.int64)
        return pack_group(part, capacity, level)[["grp", *names, "fill", "merged"]]

    return run


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """``pieces`` (``doc, piece, start, length, ids_crc32``) with ``item`` (the
    sequence) and ``offset``.  Which pieces share a sequence depends on the rows
    alone; the numbers of full sequences are any.

    Groups merge only while a merged group stays within some two times
    ``items_per_group`` rows: where bins that hardly merge pile up, the tree
    ends with several roots, each the same mixture of what is left, instead of
    one task that holds all of it.  No rows give no rows."""
    full = pieces.where(F.col("length") == capacity)
    # a full piece is a sequence; ids below zero can't meet the packed ones.  Equal rows get numbers of their own.
    full = full.withColumn("item", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc", "piece", "start", "length", "ids_crc32", "item", "offset"]
    done = [full.select(*names)]
    todo = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-todo.count() // items_per_group))
    todo = todo.withColumn("grp", F.pmod(F.xxhash64("doc", "piece", "start"), F.lit(groups)).cast("int")).withColumn("item", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    kind = pieces.schema["doc"].dataType.simpleString()
    schema = f"grp int, doc {kind}, piece int, start long, length long, ids_crc32 long, item long, offset long, fill long, merged boolean"
    final = F.col("fill") >= int(NEARLY_FULL * capacity)
    level = 0
    while True:
        level += 1

        packed = stored(todo.select("grp", *names).groupBy("grp").applyInPandas(_packer(level, capacity, names), schema))
        open_rows, merged = packed.agg(F.count_if(~final), F.count_if("merged")).first()
        # as few groups next as the fan-in and the bound on rows allow
        wanted = max(-(-groups // FAN_IN), -(-open_rows // items_per_group))
        if groups == 1 or wanted >= groups or (level > 1 and not merged):
            done.append(packed.select(*names))
            break
        done.append(packed.where(final).select(*names))
        fan = -(-groups // wanted)
        todo = packed.where(~final).withColumn("grp", F.expr(f"grp div {fan}").cast("int"))
        groups = -(-groups // fan)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32,
    sequence_id, offset``.

    A null or empty text is its end id alone.  Long texts are cut every
    ``length`` ids, others never.  Rows that repeat an id are packed each on
    their own.  Null ids are ids like any other.  Empty input: empty output.
    Other columns play no part."""
    pieces = stored(token_pieces(docs, id_col, text_col, length, tokenizer))
    out = pack_pieces(pieces, length)
    return out.select(
        F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("item").alias("sequence_id"), F.col("offset").cast("long").alias("offset")
    )


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """``sequence_id, ids`` of at most ``length`` ids: the packed sequences
    themselves.  The pieces' ids are joined to their places by document, piece
    and checksum; a sequence never has more pieces than ids."""
    places = stored(pack(docs, id_col, text_col, length, tokenizer))
    ids = token_pieces(docs, id_col, text_col, length, tokenizer, with_ids=True).dropDuplicates(["doc", "piece", "ids_crc32", "length"])
    both = places.join(
        ids.select(F.col("doc").alias("_d"), F.col("piece").alias("_p"), F.col("ids_crc32").alias("_c"), F.col("length").alias("_l"), "ids"),
        q(id_col).eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_p")) & (F.col("ids_crc32") == F.col("_c")) & (F.col("length") == F.col("_l")),
    )
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
