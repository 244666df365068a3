"""Boxes and viewports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: share of an element that must be inside the viewport.
IN_VIEWPORT_RATIO = 0.6


def viewport_ratio(
    left: Column, top: Column, width: Column, height: Column,
    window_width: float, window_height: float, compat: bool = False,
) -> Column:
    """Share of a box inside the window. ``compat`` multiplies by the height instead of dividing."""
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(left + width, F.lit(float(window_width))) - F.greatest(left, zero))
    down = F.greatest(zero, F.least(top + height, F.lit(float(window_height))) - F.greatest(top, zero))
    overlap = across * down
    if compat:
        return F.try_divide(overlap, width) * height
    return F.try_divide(overlap, width * height)


def in_viewport(ratio: Column, threshold: float = IN_VIEWPORT_RATIO) -> Column:
    return F.coalesce(ratio >= threshold, F.lit(False))


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return F.sqrt(total)
