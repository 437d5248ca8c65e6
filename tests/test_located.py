"""Drawings are found at any pixel."""

import numpy as np
import pytest

from assaymill.operators import pixels


def drawn(stroke):
    out = np.full((60, 80), 255, np.uint8)
    for a, b in ((5, 12), (30, 20), (48, 55)):
        out[a : a + stroke, 6:70] = 0
        out[8:52, b : b + stroke] = 0
    return out


@pytest.mark.parametrize("stroke", [1, 2])
@pytest.mark.parametrize("at", [(y, x) for y in range(21, 25) for x in range(33, 37)])
def test_thin_strokes_at_any_offset(stroke, at):
    page = np.full((150, 170), 255, np.uint8)
    y, x = at
    page[y : y + 60, x : x + 80] = drawn(stroke)
    assert pixels.located(page, drawn(stroke)) == (x, y, x + 80, y + 60)
    assert pixels.placed(page, [drawn(stroke)]) == [(x, y, x + 80, y + 60)]


def test_correlations_are_those_of_each_window():
    r = np.random.default_rng(1)
    page, small = r.integers(0, 256, (30, 41), dtype=np.uint8), r.integers(0, 256, (7, 9), dtype=np.uint8)
    page[:12, :15] = 255
    want = [[pixels.correlation(page[y : y + 7, x : x + 9], small) for x in range(33)] for y in range(24)]
    assert np.allclose(pixels.correlations(page, small), want)


def test_fallback_is_the_centre():
    page = np.full((100, 120), 255, np.uint8)
    assert pixels.located(page, drawn(1)) is None
    assert pixels.placed(page, [drawn(1), np.zeros((300, 300), np.uint8)]) == [(20, 20, 100, 80), (0, 0, 120, 100)]
