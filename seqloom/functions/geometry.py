"""Predicates over closed axis-parallel rectangles (x, y, w, h) and intervals, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def intersects(a: str = "a_", b: str = "b_") -> Column:
    """Closed rectangles share a point; columns are <prefix>x, y, w, h."""
    return (
        (_c(a, "x") <= _c(b, "x") + _c(b, "w")) & (_c(b, "x") <= _c(a, "x") + _c(a, "w"))
        & (_c(a, "y") <= _c(b, "y") + _c(b, "h")) & (_c(b, "y") <= _c(a, "y") + _c(a, "h"))
    )


def in_window(x: int, y: int, w: int, h: int, prefix: str = "") -> Column:
    """The rectangle touches a fixed window."""
    return (
        (_c(prefix, "x") <= x + w) & (_c(prefix, "x") + _c(prefix, "w") >= x) & (_c(prefix, "y") <= y + h) & (_c(prefix, "y") + _c(prefix, "h") >= y)
    )


def within(d: int, a: str = "a_", b: str = "b_") -> Column:
    """The Euclidean gap between two rectangles is at most d."""
    gap = lambda p, s: F.greatest(F.lit(0), _c(b, p) - (_c(a, p) + _c(a, s)), _c(a, p) - (_c(b, p) + _c(b, s)))
    return gap("x", "w") * gap("x", "w") + gap("y", "h") * gap("y", "h") <= d * d


def interval_touches(start: Column, end: Column, lo: int, hi: int) -> Column:
    return (start <= hi) & (end >= lo)
