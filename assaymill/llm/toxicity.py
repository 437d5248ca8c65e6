"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words sums over their common subsequences of 3 and 4 symbols
(word ends are symbols), each occurrence weighted by ``DECAY`` to the number of
letters it skips, at most ``GAP`` in all; so letters put into an insult, or
left out of it, lower the kernel instead of zeroing it.  Landmark words span
the Nystroem features, on which a squared-hinge linear SVM is fitted.

Documents are labelled, not words: as in multiple-instance learning each toxic
document's sentence is stood for by its most telling word, chosen at first by
counts of words and stems over labelled documents, then by the SVM itself;
words of clean sentences are all negative, the highest-scoring ones most of
all.  A document scores as its highest-scoring word, through a logistic curve.

Since the kernel's feature space is explicit, the fitted expansion over the
landmarks collapses into one weight per subsequence (a table of 4 MB that is
broadcast), and scoring a word costs its own subsequences only.  Fitting runs
on the driver over the distinct words of at most ``MAX_TOXIC + MAX_CLEAN``
labelled documents, whole ones; scoring reads every whole text."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, give_back, q, text_of, tidy

#: Bounds of the labelled sample.
MAX_TOXIC, MAX_CLEAN = 1_500, 4_000
GAP, DECAY = 3, 0.6
LANDMARKS = 224
THRESHOLD = 0.3
CACHED_WORDS = 400_000
_TRIPLES = 1 << 15
_SIZE = _TRIPLES + (1 << 20)
_STEADY = 16
#: A word or stem tells when it is exp(2.5) times as frequent in toxic
#: documents and its count times that logarithm reaches 7.
LEAST_RATIO, LEAST_VALUE = 2.5, 7.0


def _tables() -> tuple[bytes, bytes, np.ndarray]:
    """Byte table that folds case and look-alike digits, the bytes to delete,
    and the 5-bit symbol of each byte that stays."""
    fold = bytearray(range(256))
    for upper in range(65, 91):
        fold[upper] = upper + 32
    for a, b in zip(b"013457@$", b"oieastas"):
        fold[a] = b
    blanks = b" \t\n\r\x0b\x0c"
    drop = bytes(b for b in range(256) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or 0x80 <= b < 0xC0 or b in blanks or b in b"@$"))
    symbol = np.full(256, 30, np.int64)
    for b in range(97, 123):
        symbol[b] = b - 96
    for b in range(0x80, 0xC0):
        symbol[b] = 27 + b % 3
    return bytes(fold), drop, symbol


_FOLD, _DROP, _SYMBOL = _tables()
#: Characters without width, which would stand between the letters of a word.
_UNSEEN = re.compile(rb"\xc2\xad|\xe2\x80[\x8b-\x8f]|\xe2\x81\xa0|\xef\xbb\xbf")
_SPELLED = re.compile(rb"(?<!\S)(?:\S\s{1,3}){2,40}\S(?!\S)")


def words_of(text: bytes) -> list[bytes]:
    """Folded words of a text; letters spelled out one by one make a word too."""
    plain = (text if text.isascii() else _UNSEEN.sub(b"", text)).translate(_FOLD, _DROP)
    found = plain.split()
    spelled = [b"".join(x.split()) for x in _SPELLED.findall(plain)]
    return found + spelled if spelled else found


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    out = []
    for p in (3, 4):
        for more in itertools.combinations(range(1, p + GAP), p - 1):
            out.append(((0, *more), DECAY ** (more[-1] + 1 - p)))
    return out


_OFFSETS = _offsets()


def _norm(n: int) -> float:
    n = min(n, _STEADY)
    return max(1e-9, sum(w * w * max(0, n - o[-1]) for o, w in _OFFSETS)) ** 0.5


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words of each length and their symbols, ends marked."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0, True]) if len(words) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = int(lengths[order[a]])
        for c in range(a, b, max(1, 400_000 // (n + 2))):
            some = order[c : min(b, c + max(1, 400_000 // (n + 2)))]
            symbols = np.zeros((len(some), n + 2), np.int32)
            if n:
                symbols[:, 1:-1] = _SYMBOL[np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8)].reshape(len(some), n)
            symbols[:, -1] = 31
            yield some, symbols


def subsequences(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Feature numbers (words x places) of each pattern of skips, and its
    weight over the norm."""
    n = symbols.shape[1]
    norm = _norm(n)
    for offset, weight in _OFFSETS:
        m = n - offset[-1]
        if m <= 0:
            continue
        code = symbols[:, :m]
        for o in offset[1:]:
            code = (code << 5) | symbols[:, o : o + m]
        yield (code if len(offset) == 3 else code + _TRIPLES), weight / norm


def linear(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Sum of the words' features weighted by ``table``."""
    out = np.zeros(len(words), np.float64)
    for some, symbols in by_length(words):
        total = np.zeros(len(some))
        for code, weight in subsequences(symbols):
            total += weight * table[code].sum(axis=1)
        out[some] = total
    return out


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel of every word with every landmark."""
    used: dict[int, int] = {}
    rows: list[tuple[int, int, float]] = []
    for some, symbols in by_length(landmarks):
        for code, weight in subsequences(symbols):
            for k, codes in zip(some.tolist(), code.tolist()):
                for c in codes:
                    rows.append((used.setdefault(c, len(used) + 1), k, weight))
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    at = np.array(rows, dtype=[("f", np.int64), ("k", np.int64), ("w", np.float32)])
    np.add.at(dense, (at["f"], at["k"]), at["w"])
    index = np.zeros(_SIZE, np.int32)
    index[list(used)] = list(used.values())
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for some, symbols in by_length(words):
        for code, weight in subsequences(symbols):
            where = index[code]
            hit = np.flatnonzero(where.any(axis=1))
            for c in range(0, len(hit), 512):  # bounds the gathered rows
                part = hit[c : c + 512]
                out[some[part]] += weight * dense[where[part]].sum(axis=1)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights minimising the squared hinge, by Newton steps; the last column of
    ``x`` is ones, its weight the bias.  Active rows are summed block by block,
    so that no copy of ``x`` is made."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w) < 1)
        square, side = np.diag(penalty), np.zeros(x.shape[1])
        for k in range(0, len(active), 1024):
            some = active[k : k + 1024]
            a = x[some]
            weighted = a.T * cost[some]
            square += weighted @ a
            side += weighted @ y[some]
        new = np.linalg.solve(square, side)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


@dataclass
class Model:
    """Weights by subsequence, bias, and the logistic curve of a document's
    highest word."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def curve(self, top: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * top + self.shift, -30, 30)))


#: What words score that have no subsequence at all, and texts without words.
_NOTHING = b""


def _likeness(words: Collection[bytes]) -> tuple:
    """Equal for most near copies: the smallest hashes of the longer words."""
    hashes = sorted(zlib.crc32(w) for w in words if len(w) > 7)
    return tuple(hashes[:3]) if len(hashes) >= 3 else (*hashes, *sorted(words)[:50])


def _telling(docs: list[Collection[bytes]], toxic: np.ndarray) -> Counter:
    """Words that tell toxic documents, and of how many: for each document the
    word whose own or whose stem's count over toxic and clean documents tells
    most, and every word whose own count tells by itself."""
    stems = lambda w: {w, *(w[:k] + b"*" for k in (3, 4, 5, 6) if len(w) > k)}
    of_toxic: Counter = Counter()
    for words, label in zip(docs, toxic):
        if label:
            of_toxic.update({s for w in words for s in stems(w)})
    of_toxic = Counter({s: n for s, n in of_toxic.items() if n > 1})
    of_clean: Counter = Counter()
    for words, label in zip(docs, toxic):
        if not label:
            of_clean.update({s for w in words for s in stems(w) if s in of_toxic})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))

    def value(stem: bytes) -> float:
        a, b = of_toxic[stem], of_clean[stem]
        ratio = np.log((a + 0.5) / n1 * n0 / (b + 0.5))
        return float(a * ratio) if a > 1 and ratio >= LEAST_RATIO else 0.0

    best = {s: v for s in of_toxic if (v := value(s)) >= LEAST_VALUE}
    out: Counter = Counter()
    for words, label in zip(docs, toxic):
        if label:
            top = max(((best.get(s, 0.0), w) for w in words for s in stems(w)), default=(0.0, _NOTHING))
            out.update({top[1]} if top[0] > 0 else ())
            out.update(w for w in words if best.get(w, 0.0) >= 2 * LEAST_VALUE and w != top[1])
    return out


def _varied(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one letter put in."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + bytes([97 + int(rng.integers(26))]) + word[at:]


def fit(texts: list[bytes], toxic: list[bool], seed: int = 5, landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    """The model of labelled texts (see :func:`fit_words`)."""
    return fit_words([set(words_of(t)) for t in texts], toxic, seed, landmarks, rounds)


def fit_words(docs: list[Collection[bytes]], toxic: list[bool], seed: int = 5, landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    """The model of labelled texts, given their distinct words.  With no toxic
    or no clean text, or when nothing tells them apart, every text scores the
    share of toxic ones."""
    y = np.array(toxic, bool)
    once = {_likeness(words): k for k, words in enumerate(docs)}
    once = sorted(once.values())  # copies of one text would make all its words telling
    docs, y = [docs[k] for k in once], y[once]
    prior = float(y.mean()) if len(y) else 0.0
    flat = Model(np.zeros(_SIZE, np.float32), 0.0, 0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    if not len(y) or y.all() or not y.any():
        return flat
    rng = np.random.default_rng(seed)
    chosen = _telling(docs, y)
    clean = Counter(w for words, label in zip(docs, y) if not label for w in words)
    everyday = sorted(clean)
    few = lambda w: clean[w] <= 2 or clean[w] <= 0.02 * chosen[w]
    positive = sorted(w for w in chosen if few(w))
    if not positive or not everyday:
        return flat
    hard: list[bytes] = []
    vocabulary = sorted({w for words in docs for w in words})
    number = {w: k for k, w in enumerate(vocabulary)}
    # frequent words of clean texts, and others at random
    usual = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:2000]]
    some = [everyday[k] for k in rng.choice(len(everyday), min(6000, len(everyday)), replace=False)]
    for _ in range(rounds):
        varied = [_varied(w, rng) for w in positive for _ in range(3)]
        negative = sorted({*usual, *some, *hard} - set(positive))
        marks = sorted(positive, key=lambda w: (-chosen[w], w))[: landmarks // 4]
        marks += [positive[k] for k in rng.choice(len(positive), min(landmarks // 4, len(positive)), replace=False)]
        pool = sorted(set(hard)) or negative
        marks += [pool[k] for k in rng.choice(len(pool), min(landmarks // 4, len(pool)), replace=False)]
        marks += [negative[k] for k in rng.choice(len(negative), min(landmarks // 4, len(negative)), replace=False)]
        marks = sorted(set(marks))
        base = kernel(marks, marks).astype(np.float64)
        values, vectors = np.linalg.eigh((base + base.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        examples = [*positive, *varied, *negative]
        label = np.r_[np.ones(len(positive) + len(varied)), -np.ones(len(negative))]
        weight = np.r_[[4.0 + min(60, chosen[w]) for w in positive], [1.0 + min(8, chosen[w] / 4) for w in positive for _ in range(3)], [2.0 + min(60, clean[w]) ** 0.5 for w in negative]]
        x = np.ones((len(examples), len(marks) + 1))
        for k in range(0, len(examples), 4096):
            x[k : k + 4096, :-1] = kernel(examples[k : k + 4096], marks) @ root
        w = _svm(x, label, weight, ridge=0.2)
        del x
        alpha = root @ w[:-1]
        table = np.zeros(_SIZE, np.float64)
        for where, symbols in by_length(marks):
            for code, part in subsequences(symbols):
                np.add.at(table, code, part * alpha[where][:, None])
        table = table.astype(np.float32)
        value = linear(vocabulary, table) + w[-1]
        tops = [max((float(value[number[x]]), x) for x in words) if words else (-2.0, _NOTHING) for words in docs]
        hard = sorted({*hard, *(x for (_, x), t in zip(tops, y) if not t and x)})
        counts = Counter(x for (v, x), t in zip(tops, y) if t and x and v > 0 and few(x))
        positive = sorted({*counts, *(w for w in positive if value[number[w]] > -0.5 or chosen[w] > 3)})
        if not positive:
            return flat
    top = np.array([v for v, _ in tops])
    slope, shift = _logistic(top, y)
    return Model(table, float(w[-1]), slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with a little ridge on the slope."""
    a, b, t = 1.0, 0.0, y.astype(np.float64)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 0.1 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Scorer:
    """Scores texts, remembering words."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def tops(self, texts: list[bytes]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.seen) > CACHED_WORDS:
            self.seen = {}
        new = list({w for words in split for w in words if w not in self.seen})
        self.seen.update(zip(new, (linear(new, self.model.table) + self.model.bias).tolist()))
        get = self.seen.__getitem__
        return np.array([max(map(get, words), default=-2.0) for words in split])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.model.curve(self.tops(texts)) if texts else np.empty(0)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels aren't learned from; null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(q(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a bounded sample of labelled rows that aren't held out: of each
    label those with the smallest hashes of their ids.  Only their distinct
    words reach the driver.  Rows without a label, an id or a document are
    passed over; empty tables give the model of no texts."""
    known = labels.where(q(id_col).isNotNull() & q(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(q(id_col).alias("_am_id")).agg(F.max(q(label_col)).alias("_am_label"))
    order = [F.xxhash64("_am_id"), F.col("_am_id")]
    sample = known.where("_am_label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("_am_label = 0").orderBy(*order).limit(MAX_CLEAN))
    texts = docs.select(q(id_col).alias("_am_id"), text_of(text_col).cast("binary").alias("_am_text"))
    rows = texts.join(F.broadcast(sample), "_am_id").groupBy("_am_id").agg(F.min("_am_text").alias("t"), F.max("_am_label").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(sorted(set(words_of(t.as_py())))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), batch.column(2)], names=["id", "words", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.select("_am_id", "t", "y").mapInArrow(tidy(run), f"id {kinds['_am_id']}, words binary, y {kinds['y']}").orderBy("id").collect()
    # one object for each distinct word, and tuples, which take a tenth of the room of sets
    one: dict[bytes, bytes] = {}
    words = [tuple(one.setdefault(w, w) for w in bytes(r.words).split(b" ") if w) for r in found]
    model = fit_words(words, [r.y == 1 for r in found])
    del found, words, one
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on).

    The score is a function of the text alone.  Null and empty texts score as
    texts without words.  Repeated rows each get a row.  Empty input: empty
    output.  Input columns named like the result's are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 4 MB
    names = carried(docs, [x for x in ("score", "predicted", "_am_text") if x not in (id_col, text_col)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                texts = [x or b"" for x in part.column(part.num_columns - 1).to_pylist()]
                value = pa.array(scorer.scores(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], value], schema=pa.schema([*list(part.schema)[:-1], pa.field("score", pa.float64())]))

    rows = docs.select(*map(q, names), text_of(text_col).cast("binary").alias("_am_text"))
    schema = rows.drop("_am_text").schema.add("score", "double")
    return rows.mapInArrow(tidy(run), schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
