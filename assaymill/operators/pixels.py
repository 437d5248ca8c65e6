"""Kernels on grayscale pages, vectorised in numpy.

Pages and regions arrive as raw bytes with width and height; each kernel is a
pandas function over batches, pure and per row, so it scales as a projection.
``register`` of :mod:`assaymill.plans.backends` swaps in other detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DARK = 128


def image(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)[: width * height].reshape(height, width)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def has_graphics(page: np.ndarray) -> bool:
    """Two of ten strips with dark ink over 0.5 % that isn't spread over all of
    the width, and an extent of at least 80."""
    good = 0
    for strip in np.array_split(page, 10):
        dark = strip < DARK
        columns = dark.any(axis=0)
        if dark.mean() >= 0.005 and columns.mean() < 0.8 and columns.any() and np.ptp(np.flatnonzero(columns)) >= 80:
            good += 1
    return good >= 2


def has_dense_region(page: np.ndarray, cell: int = 20) -> bool:
    """A cell of 20 pixels darker than 35 %, or four in a column over 22 %."""
    h, w = page.shape[0] // cell * cell, page.shape[1] // cell * cell
    if not h or not w:
        return False
    density = (page[:h, :w] < DARK).reshape(h // cell, cell, w // cell, cell).mean(axis=(1, 3))
    if (density > 0.35).any():
        return True
    return any(b - a >= 4 for column in (density > 0.22).T for a, b in runs(column))


def has_table(page: np.ndarray) -> bool:
    """Three columns and four rows of ink bands with gaps between."""
    dark = page < DARK
    bands = lambda axis, gap: sum(1 for a, b in runs(dark.mean(axis=axis) < 0.002) if b - a >= gap)
    return bands(0, 12) + 1 >= 3 and bands(1, 4) + 1 >= 4


def has_structure_ink(region: np.ndarray) -> bool:
    """1 % ink, in six of sixteen cells."""
    dark = region < DARK
    if region.size == 0 or dark.mean() < 0.01:
        return False
    return sum(bool(c.any()) for row in np.array_split(dark, 4) for c in np.array_split(row, 4, axis=1)) >= 6


def text_lines(region: np.ndarray, gap: int = 5) -> int:
    """Bands of dark rows that stand apart by five rows."""
    bands = runs((region < DARK).any(axis=1))
    return sum(1 for k, (a, _) in enumerate(bands) if k == 0 or a - bands[k - 1][1] >= gap)


def separators(region: np.ndarray, axis: int, share: float = 0.6) -> list[int]:
    """Centres of ruled lines: rows (axis 1) or columns (axis 0) that are dark
    over most of their length."""
    return [(a + b - 1) // 2 for a, b in runs((region < DARK).mean(axis=axis) >= share)]


def without_lines(region: np.ndarray) -> np.ndarray:
    """The region with its ruled lines white."""
    out = region.copy()
    dark = region < DARK
    out[dark.mean(axis=1) >= 0.6, :] = 255
    out[:, dark.mean(axis=0) >= 0.6] = 255
    return out


def sparse_split(region: np.ndarray, axis: int) -> int:
    """The row (axis 1) or column (axis 0) of least ink in the middle 60 %."""
    ink = (region < DARK).sum(axis=axis)
    low = int(0.2 * len(ink))
    return low + int(np.argmin(ink[low : len(ink) - low] if len(ink) > 2 * low else ink))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised correlation of two regions, the second sampled to the first's
    shape; 0 for flat ones."""
    if not a.size or not b.size:
        return 0.0
    b = b[np.linspace(0, b.shape[0] - 1, a.shape[0]).astype(int)][:, np.linspace(0, b.shape[1] - 1, a.shape[1]).astype(int)]
    x, y = a - a.mean(), b - b.mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n else 0.0


def components(dark: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2) of 4-connected dark areas, by runs of each row
    united with those they touch in the row above."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(dark.shape[0]):
        now = []
        for a, b in runs(dark[y]):
            touching = {root(k) for c, d, k in above if c < b and a < d}
            if touching:
                k = min(touching)
                for t in touching - {k}:
                    parent[t] = k
                    box, other = boxes[k], boxes[t]
                    boxes[k] = [min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])]
                box = boxes[k]
                boxes[k] = [min(box[0], a), box[1], max(box[2], b), y + 1]
            else:
                k = len(parent)
                parent.append(k)
                boxes.append([a, y, b, y + 1])
            now.append((a, b, k))
        above = now
    return sorted(tuple(boxes[k]) for k in range(len(parent)) if parent[k] == k)


def autocrop(region: np.ndarray, pad: int = 5) -> tuple[int, int, int, int]:
    """Box of the largest connected drawing once ruled lines are gone, padded."""
    found = components(without_lines(region) < DARK)
    if not found:
        return 0, 0, region.shape[1], region.shape[0]
    x1, y1, x2, y2 = max(found, key=lambda b: ((b[2] - b[0]) * (b[3] - b[1]), -b[1], -b[0]))
    return max(0, x1 - pad), max(0, y1 - pad), min(region.shape[1], x2 + pad), min(region.shape[0], y2 + pad)


def drawings(page: np.ndarray, least: int = 50, widest: float = 5.0) -> list[tuple[int, int, int, int]]:
    """Candidate drawings: connected areas with sides of at least ``least`` and
    no longer than five times as wide, with ink spread over them."""
    out = []
    for x1, y1, x2, y2 in components(page < DARK):
        w, h = x2 - x1, y2 - y1
        if min(w, h) >= least and max(w, h) <= widest * min(w, h) and has_structure_ink(page[y1:y2, x1:x2]):
            out.append((x1, y1, x2, y2))
    return sorted(out, key=lambda b: (b[1], b[0]))


def extended(page: np.ndarray, box: tuple[int, int, int, int], most: int = 60) -> tuple[int, int, int, int]:
    """The box grown up and down while rows next to it hold ink."""
    x1, y1, x2, y2 = box
    ink = (page[:, x1:x2] < DARK).any(axis=1)
    top, bottom = y1, y2
    while top > 0 and y1 - top < most and ink[top - 1]:
        top -= 1
    while bottom < len(ink) and bottom - y2 < most and ink[bottom]:
        bottom += 1
    return x1, top, x2, bottom


def masked(region: np.ndarray, boxes: list[tuple[int, int, int, int]], most: float = 0.4) -> np.ndarray:
    """The region with boxes painted white, unless that takes over 40 % of its
    ink."""
    out = region.copy()
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1) : y2, max(0, x1) : x2] = 255
    before = (region < DARK).sum()
    return region if before and (before - (out < DARK).sum()) / before > most else out


def enhanced(region: np.ndarray, how: str = "stretch", size: int = 384) -> np.ndarray:
    """Preprocessing variants for recognisers: stretch (contrast), binary (at
    the mean), square (padded white), whole (unchanged)."""
    if how == "stretch":
        low, high = (int(x) for x in np.percentile(region, (2, 98)))
        return region if high <= low else np.clip((region.astype(np.float32) - low) * 255 / (high - low), 0, 255).astype(np.uint8)
    if how == "binary":
        return np.where(region < region.mean(), 0, 255).astype(np.uint8)
    if how == "square":
        n = max(size, *region.shape)
        out = np.full((n, n), 255, np.uint8)
        y, x = (n - region.shape[0]) // 2, (n - region.shape[1]) // 2
        out[y : y + region.shape[0], x : x + region.shape[1]] = region
        return out
    if how == "whole":
        return region
    raise ValueError(f"unknown variant {how!r}")


Box = tuple[int, int, int, int]


def trimmed_overlaps(boxes: list[Box], pad: int) -> list[Box]:
    """Boxes padded, and pairs whose padding overlaps trimmed to the midpoint of
    their unpadded edges, one pair after another."""
    out = [[x1 - pad, y1 - pad, x2 + pad, y2 + pad] for x1, y1, x2, y2 in boxes]
    for i, a in enumerate(boxes):
        for j in range(i + 1, len(boxes)):
            b, p, r = boxes[j], out[i], out[j]
            if p[2] <= r[0] or r[2] <= p[0] or p[3] <= r[1] or r[3] <= p[1]:
                continue
            for low, high in ((0, 2), (1, 3)):
                # only along the axis on which the drawings themselves stand apart
                if a[high] <= b[low]:
                    p[high] = r[low] = (a[high] + b[low]) // 2
                elif b[high] <= a[low]:
                    r[high] = p[low] = (b[high] + a[low]) // 2
    return [(max(0, a), max(0, b), c, d) for a, b, c, d in out]


def split_box(page: np.ndarray, box: Box, wide: int = 800, tall: int = 600, aspect: float = 2.5, least: int = 50) -> list[Box]:
    """A compound box cut into its drawings: by a grid of blank bands where it
    is wide and tall, across where it is tall, down where it is long; parts
    without a drawing's ink are dropped, and the box stays whole if fewer than
    two remain."""
    x1, y1, x2, y2 = box
    region = page[y1:y2, x1:x2]
    w, h = x2 - x1, y2 - y1
    parts: list[Box] = []
    if w > wide and h > 500:
        parts = grid_cells(region, least)
    if len(parts) < 4 and h > tall:
        at = sparse_split(region, 1)
        parts = [(0, 0, w, at), (0, at, w, h)] if (region[at] < DARK).mean() < 0.02 else []
    elif len(parts) < 4 and h and w / h > aspect:
        at = sparse_split(region, 0)
        parts = [(0, 0, at, h), (at, 0, w, h)] if (region[:, at] < DARK).mean() < 0.02 else []
    good = [(x1 + a, y1 + b, x1 + c, y1 + d) for a, b, c, d in parts if min(c - a, d - b) >= least and has_structure_ink(region[b:d, a:c])]
    return good if len(good) >= 2 else [box]


def grid_cells(region: np.ndarray, least: int = 50) -> list[Box]:
    """Cells between blank bands of rows and columns, at least two each way."""
    dark = region < DARK
    rows = [r for r in runs(dark.mean(axis=1) > 0.001) if r[1] - r[0] >= least]
    columns = [c for c in runs(dark.mean(axis=0) > 0.001) if c[1] - c[0] >= least]
    if len(rows) < 2 or len(columns) < 2:
        return []
    return [(a, top, b, bottom) for top, bottom in rows for a, b in columns]


def subdivided(region: np.ndarray, bounds: list[int], tall: int = 600, gap: int = 8) -> list[int]:
    """Row bounds with segments over 600 cut at the middle of blank bands."""
    blank = ~(region < DARK).any(axis=1)
    out = list(bounds[:1])
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > tall:
            out += [a + (c + d) // 2 for c, d in runs(blank[a:b]) if d - c >= gap and c > 0 and a + d < b]
        out.append(b)
    return out


def anchored_rows(bounds: list[int], anchors: list[int], reach: int = 40) -> list[int]:
    """Row bounds moved just above the example number next below them."""
    out = []
    for b in bounds:
        below = [a for a in anchors if 0 <= a - b <= reach or 0 < b - a <= reach // 2]
        out.append(min(below) - 2 if below else b)
    return sorted(set(max(0, b) for b in out))


def tightened(region: np.ndarray, gap: int = 25) -> tuple[int, int]:
    """The widest stretch of columns without a blank gap of 25 or more."""
    ink = (region < DARK).any(axis=0)
    spans: list[list[int]] = []
    for a, b in runs(ink):
        if spans and a - spans[-1][1] < gap:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return tuple(max(spans, key=lambda s: s[1] - s[0])) if spans else (0, region.shape[1])


def filled_rows(page: np.ndarray, table: Box, column: tuple[int, int], bounds: list[int], boxes: list[Box]) -> list[Box]:
    """Boxes for rows of a table column that have a drawing's ink but no box."""
    out = list(boxes)
    for top, bottom in zip(bounds[:-1], bounds[1:]):
        centre = (top + bottom) / 2
        held = any(b[1] <= centre <= b[3] and b[0] < column[1] and b[2] > column[0] for b in boxes)
        box = (max(table[0], column[0]), max(table[1], top), min(table[2], column[1]), min(table[3], bottom))
        if not held and has_structure_ink(page[box[1] : box[3], box[0] : box[2]]):
            out.append(box)
    return sorted(out, key=lambda b: (b[1], b[0]))


def accepted(page: np.ndarray, candidate: Box, sample: Box, least: float = -0.3) -> bool:
    """Whether a candidate has ink and doesn't contradict a known drawing."""
    cut = lambda b: page[b[1] : b[3], b[0] : b[2]]
    return has_structure_ink(cut(candidate)) and correlation(cut(candidate), cut(sample)) >= least


def correlations(page: np.ndarray, drawing: np.ndarray) -> np.ndarray:
    """Normalised correlation of a drawing with the page at every pixel where it
    fits, 0 on flat areas: products by FFT, means and norms by running sums."""
    h, w = drawing.shape
    y = drawing - drawing.mean()
    norm = (y * y).sum()
    level = page - page.mean()

    def sums(x: np.ndarray) -> np.ndarray:
        run = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return run[h:, w:] - run[:-h, w:] - run[h:, :-w] + run[:-h, :-w]

    ink = page.astype(np.int64)
    spread = sums(ink * ink) - sums(ink).astype(float) ** 2 / (h * w)
    products = np.fft.irfft2(np.fft.rfft2(level) * np.conj(np.fft.rfft2(y, page.shape)), page.shape)[: page.shape[0] - h + 1, : page.shape[1] - w + 1]
    some = (spread > 0.25) & (norm > 0.25)  # of whole grey levels, less is rounding
    return np.where(some, products / np.sqrt(np.where(some, spread * norm, 1.0)), 0.0)


def _best(page: np.ndarray, drawing: np.ndarray) -> tuple[float, Box]:
    found = correlations(page, drawing)
    y, x = map(int, np.unravel_index(np.argmax(found), found.shape))
    return float(found[y, x]), (x, y, x + drawing.shape[1], y + drawing.shape[0])


def located(page: np.ndarray, drawing: np.ndarray, scales: tuple[float, ...] = (0.4, 0.55, 0.7, 0.85, 1.0, 1.15, 1.3, 1.45, 1.6), least: float = 0.5) -> Box | None:
    """Where a drawing best correlates with the page over scales and all
    pixels; None unless above the least correlation."""
    best: tuple[float, Box] | None = None
    for scale in scales:
        h, w = (max(1, int(n * scale)) for n in drawing.shape)
        if h > page.shape[0] or w > page.shape[1]:
            continue
        small = drawing[np.linspace(0, drawing.shape[0] - 1, h).astype(int)][:, np.linspace(0, drawing.shape[1] - 1, w).astype(int)]
        found = _best(page, small)
        if best is None or found[0] > best[0]:
            best = found
    return best[1] if best and best[0] > least else None


def placed(page: np.ndarray, drawings: list[np.ndarray], least: float = 0.3) -> list[Box]:
    """A box for each drawing at its own scale: where it correlates best, the
    page's centre if it is as large as the page or not above ``least``."""
    out, (ph, pw) = [], page.shape
    for drawing in drawings:
        h, w = drawing.shape
        score, box = _best(page, drawing) if h < ph and w < pw else (0.0, (0, 0, 0, 0))
        out.append(box if score > least else (max(0, (pw - w) // 2), max(0, (ph - h) // 2), min(pw, (pw + w) // 2), min(ph, (ph + h) // 2)))
    return out


def ordered_detection(pages: DataFrame, step: Callable[[np.ndarray, dict], list[Box]]) -> DataFrame:
    """Boxes of pages read in order within a file, with state carried along
    (``step(page, state)``): for detectors that reuse a table's columns on its
    next page.  Pages stream from sorted partitions; memory holds one page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, state = None, {}
        for part in batches:
            rows = []
            for f, p, raw, w, h in zip(part["file"], part["page"], part["gray"], part["width_px"], part["height_px"]):
                if f != file:
                    file, state = f, {}
                if raw is not None:
                    rows += [(f, p, k, *b) for k, b in enumerate(step(image(raw, w, h), state), 1)]
            yield pd.DataFrame(rows, columns=["file", "page", "box_no", "x1", "y1", "x2", "y2"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    ordered = pages.select("file", "page", "gray", "width_px", "height_px").repartition("file").sortWithinPartitions("file", "page")
    return ordered.mapInPandas(run, f"file {kinds['file']}, page {kinds['page']}, box_no long, x1 long, y1 long, x2 long, y2 long")


def test(kernel: Callable[[np.ndarray], bool | int | float], kind: str = "boolean") -> Callable[[Column, Column, Column], Column]:
    """A kernel of one image as a Column function of bytes, width, height; null
    or short bytes give null."""

    @F.pandas_udf(kind)
    def run(raw: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or w is None or h is None or len(r) < w * h else kernel(image(r, int(w), int(h))) for r, w, h in zip(raw, width, height)], dtype=object)

    return run


def detect(pages: DataFrame, kernel: Callable[[np.ndarray], list[tuple[int, int, int, int]]] = drawings) -> DataFrame:
    """``file, page, box_no, x1, y1, x2, y2`` of the boxes a kernel finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(f, p, k, *b) for f, p, raw, w, h in zip(part["file"], part["page"], part["gray"], part["width_px"], part["height_px"]) if raw is not None for k, b in enumerate(kernel(image(raw, w, h)), 1)]
            yield pd.DataFrame(rows, columns=["file", "page", "box_no", "x1", "y1", "x2", "y2"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("file", "page", "gray", "width_px", "height_px").mapInPandas(run, f"file {kinds['file']}, page {kinds['page']}, box_no long, x1 long, y1 long, x2 long, y2 long")


BYTES = T.BinaryType()
