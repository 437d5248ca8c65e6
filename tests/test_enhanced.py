"""Variants that aren't built are refused."""

import numpy as np
import pytest

from assaymill.operators import pixels


def test_unknown_variant_is_refused():
    region = np.arange(100, dtype=np.uint8).reshape(10, 10)
    assert pixels.enhanced(region, "whole") is region
    with pytest.raises(ValueError):
        pixels.enhanced(region, "clahe")
