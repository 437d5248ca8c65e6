"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags).  Each
block becomes the sum of hashed vectors of its tag path (tags, classes, ids of
all ancestors), the mean of hashed vectors of its words, and a few counts; a
bidirectional LSTM in numpy reads the page's whole sequence of blocks, and a
logistic layer keeps or drops each.  The weights beside this module were
trained by ``html_train`` on generated pages.

Pages are independent: one pass, no shuffle.  Within a batch pages of similar
length run together, so numpy works on matrices."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, q, text_of

PATHS, WORDS, COUNTS = 1024, 2048, 8
WEIGHTS = Path(__file__).with_name("html_weights.npz")

#: Elements whose content is no markup, up to their end tag or the page's end.
#: (Empty titles and styles are those of drawings.)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea")}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_AFTER_NAME = frozenset(" \t\n\r\x0b\x0c/>")
_EMPTY = re.compile(r"\s*/>")
_SPECIAL = re.compile(r"[>\"']")
#: Ancestors whose features describe a block: the nearest ones.
NEAREST = 64
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes implicitly, and the tags past which it doesn't look.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
#: What ends a drawing that was left open.
_BREAKOUT = _BLOCK | frozenset("b big br code em embed hr i img meta nobr ruby s small span strike strong sub sup tt u var".split())
_SCOPE = frozenset("article aside body div dl footer form header html li main nav ol section table td th ul".split())


@dataclass
class Block:
    """A leaf: its text, the features of its path, and the share of link text."""

    text: str
    path: tuple[int, ...]
    linked: float


@lru_cache(maxsize=1 << 14)
def _few_features(tag: str, attrs: str) -> tuple[int, ...]:
    words = {tag}
    for kind, *values in _NAMES.findall(attrs):
        for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower()):
            words.add("." + word)
    return tuple(sorted({zlib.crc32(w.encode()) % PATHS for w in words}))


def _features(tag: str, attrs: str) -> tuple[int, ...]:
    """Hashed features of one element: its tag, and words of class, id, role.
    Short ones are remembered."""
    return (_few_features if len(attrs) < 512 else _few_features.__wrapped__)(tag, attrs)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag in lower case, whether it closes, attributes) of all
    markup in order; comments, declarations and raw elements have no tag.

    One pass: whatever is looked for is looked for once.  A ``>`` in quotes
    doesn't end a tag unless its quotes never close; the places from which that
    was found out are remembered, so no stretch is tried twice in one state."""
    n, at = len(page), 0
    failed: set[int] = set()

    def tag_end(start: int) -> int:
        seen, pos = [], start
        while m := _SPECIAL.search(page, pos):
            p = m.start()
            if page[p] == ">":
                return p
            if p in failed:
                break
            seen.append(p)
            pos = page.find(page[p], p + 1) + 1
            if not pos:
                break
        failed.update(seen)
        return page.find(">", start)

    last = page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, ""
        elif at > last:  # nothing ends any more but comments
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        else:
            closes = page.startswith("/", at + 1)
            m = _NAME.match(page, at + 1 + closes)
            if not m:
                at += 1
                continue
            tag = m[0].lower()
            raw = None if closes or page[m.end() : m.end() + 1] not in _AFTER_NAME else _RAW.get(tag)
            if raw is not None and not (tag in ("title", "style") and _EMPTY.match(page, m.end())):
                close = raw.search(page, page.find(">", m.end()) + 1)
                end = page.find(">", close.end()) + 1 if close else n
                end = end or n
                yield at, end, "", False, ""
            else:
                end = tag_end(m.end()) + 1
                yield at, end, tag, closes, page[m.end() : end - 1]
        at = end


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order.  Never fails: what isn't markup is text.
    Takes time in proportion to the page, however it is nested."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    # where the open elements of each tag stand in the stack; those that are blocks, and those that bound implied end tags
    where: dict[str, list[int]] = {}
    owners: list[str] = []
    scopes: list[int] = []
    parts: list[str] = []
    linked = 0
    open_at = lambda tag: where[tag][-1] if where.get(tag) else -1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = {f for _, features in stack[-NEAREST:] for f in features}
                path.add(zlib.crc32(b"own " + (owners[-1] if owners else "").encode()) % PATHS)
                out.append(Block(text, tuple(sorted(path)), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def push(tag: str, attrs: str) -> None:
        where.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            owners.append(tag)
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, _features(tag, attrs)))

    def pop(to: int) -> None:
        for tag, _ in stack[to:]:
            where[tag].pop()
            if tag in _BLOCK:
                owners.pop()
            if tag in _SCOPE:
                scopes.pop()
        del stack[to:]

    at = 0
    for start, end, tag, closes, attrs in tokens(page):
        if start > at and not where.get("svg"):
            parts.append(page[at:start])
            linked += start - at if where.get("a") else 0
        at = end
        if not tag:
            continue
        if closes:
            if tag in _BLOCK:
                flush()
            if where.get(tag):
                pop(open_at(tag))
            continue
        if where.get("svg") and tag in _BREAKOUT:
            pop(where["svg"][0])
        if tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            ends = max(map(open_at, ("p", *_CLOSES.get(tag, ()))))
            if ends >= 0 and ends >= (scopes[-1] if scopes else -1):
                pop(ends)
        if tag not in _VOID and not attrs.endswith("/"):
            push(tag, attrs)
    if at < len(page) and not where.get("svg"):
        parts.append(page[at:])
    flush()
    return out


_PLAIN = bytes(b for b in range(256) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 or b in b" "))


def inputs(page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Path features, word features and counts of each block."""
    words, counts = [], np.zeros((len(page), COUNTS), np.float32)
    n = len(page)
    for k, b in enumerate(page):
        plain = b.text.lower().encode("utf-8", "replace").translate(None, _PLAIN).split()
        words.append(np.fromiter(map(zlib.crc32, plain), np.int64, len(plain)) % WORDS)
        size = len(b.text)
        stops = b.text.count(". ") + b.text.count(", ") + b.text.endswith((".", "!", "?"))
        counts[k] = (
            np.log1p(size) / 4,
            np.log1p(len(plain)) / 3,
            b.linked,
            min(1.0, 8 * stops / (len(plain) + 4)),
            float(b.text.endswith((".", "!", "?", "…"))),
            sum(map(b.text.count, "0123456789")) / (size + 1),
            k / n,
            1.0,
        )
    return [np.array(b.path, np.int64) for b in page], words, counts


def bag(table: np.ndarray, lists: list[np.ndarray], mean: bool) -> np.ndarray:
    """Sums or means of the rows of ``table`` that each list names."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        names = np.concatenate([lists[k] for k in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        for a in range(0, len(some), 4096):  # bounds the gathered rows
            b = min(len(some), a + 4096)
            lo, hi = starts[a], starts[b] if b < len(some) else len(names)
            out[some[a:b]] = np.add.reduceat(table[names[lo:hi]], starts[a:b] - lo, axis=0)
        if mean:
            out /= np.maximum(sizes, 1)[:, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, page, unit) of one direction; padded steps pass the state
    on.  ``keep`` collects what back-propagation needs."""
    steps, pages, _ = x.shape
    units = u.shape[0]
    h, c = np.zeros((pages, units), np.float32), np.zeros((pages, units), np.float32)
    out = np.empty((steps, pages, units), np.float32)
    pre = x @ w + b
    for t in range(steps):
        z = pre[t] + h @ u
        i, f, o = sigmoid(z[:, :units]), sigmoid(z[:, units : 2 * units]), sigmoid(z[:, 2 * units : 3 * units])
        g = np.tanh(z[:, 3 * units :])
        new = f * c + i * g
        shape = np.tanh(new)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, shape, m))
        c = m * new + (1 - m) * c
        h = m * (o * shape) + (1 - m) * h
        out[t] = h
    return out


class Labeller:
    """The network's weights and its forward pass."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> "Labeller":
        with np.load(path) as stored:
            return cls(dict(stored))

    def embedded(self, page: list[Block]) -> np.ndarray:
        paths, words, counts = inputs(page)
        return np.concatenate([bag(self.w["paths"], paths, False), bag(self.w["words"], words, True), counts], axis=1)

    def keep(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For every page which blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            # pages of similar length, some 20,000 padded blocks together
            end, longest = at + 1, len(pages[order[at]])
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= 20_000 and len(pages[order[end]]) <= 1.3 * longest + 4:
                end += 1
            some = order[at:end]
            steps = len(pages[some[-1]])
            x = np.zeros((steps, len(some), self.w["wf"].shape[0]), np.float32)
            mask = np.zeros((steps, len(some)), np.float32)
            for n, k in enumerate(some):
                e = self.embedded(pages[k])
                x[: len(e), n], mask[: len(e), n] = e, 1
            logit = self.logits(x, mask)
            for n, k in enumerate(some):
                out[k] = logit[: len(pages[k]), n] > 0
            at = end
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        w = self.w
        ahead = lstm(x, mask, w["wf"], w["uf"], w["bf"])
        back = lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"])[::-1]
        return ahead @ w["of"] + back @ w["ob"] + w["o"]


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, k in zip(page, keep) if k) for page, keep in zip(cut, labeller.keep(cut))]


@lru_cache(maxsize=1)
def _loaded() -> Labeller:
    return Labeller.load()


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text, empty if none) and ``n_chars``, in
    place of the html.

    White space within a block becomes one space, blocks are joined in page
    order by an empty line.  Null and empty html give an empty text; broken
    markup is read as far as it goes.  Repeated rows each get a row.  Empty
    input: empty output.  Input columns named like the result's are replaced."""
    names = carried(pages, ["text", "n_chars", "_am_html", html_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _loaded()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                found = main_texts([x or "" for x in part.column(part.num_columns - 1).to_pylist()], labeller)
                out = [*part.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([*list(part.schema)[:-1], pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]))

    rows = pages.select(*map(q, names), text_of(html_col).alias("_am_html"))
    return rows.mapInArrow(run, rows.drop("_am_html").schema.add("text", "string").add("n_chars", "long"))
