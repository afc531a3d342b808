"""Expressions on pixels: masks, finite values, and bins in float32 arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CubeError
from ..model import MOST_BINS


def folded(value: Column, flagged: Column) -> Column:
    """NaN where the pixel is flagged as bad."""
    return F.when(flagged, F.lit(float("nan")).cast("float")).otherwise(value.cast("float"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def good(value: Column, flagged: Column | None = None) -> Column:
    """The value as double where it is finite and not flagged, else null, so that aggregates pass it over."""
    ok = finite(value) if flagged is None else finite(value) & ~F.coalesce(flagged, F.lit(False))
    return F.when(ok, value.cast("double"))


def or_nan(x: Column) -> Column:
    """NaN for null: an extremum over nothing."""
    return F.coalesce(x, F.lit(float("nan")))


class Bins:
    """bin_count equal bins from lower to upper, by the float32 rule.

    Bounds are narrowed to float32 and the width is (upper - lower) / bin_count in double, narrowed;
    a value's bin is (value - lower) / width in float32, at most the last.  Where the narrowed span
    or width is not a positive finite number, bins are found in double between the narrowed bounds.
    """

    def __init__(self, bin_count: int, lower: float, upper: float):
        most = float(np.finfo(np.float32).max)
        if not 1 <= bin_count <= MOST_BINS:
            raise CubeError("invalid_argument", f"{bin_count} bins")
        if not (math.isfinite(lower) and math.isfinite(upper) and lower < upper and abs(lower) <= most and abs(upper) <= most):
            raise CubeError("invalid_argument", f"bounds {lower} and {upper}")
        self.bin_count = bin_count
        self.low, self.high = np.float32(lower), np.float32(upper)
        with np.errstate(all="ignore"):
            span, self.width = self.high - self.low, np.float32((upper - lower) / bin_count)
        self.plain = bool(span > 0 and np.isfinite(span) and self.width > 0 and np.isfinite(self.width))
        self.wide = (float(self.high) - float(self.low)) / bin_count

    def index(self, value: Column) -> Column:
        """Bin of a value; null outside the bounds and for NaN."""
        v = value.cast("float")
        inside = (v >= F.lit(float(self.low)).cast("float")) & (v <= F.lit(float(self.high)).cast("float")) & ~F.isnan(v)
        if self.plain:
            at = ((v - F.lit(float(self.low)).cast("float")).cast("float") / F.lit(float(self.width)).cast("float")).cast("float").cast("int")
        elif self.wide > 0:
            at = ((v.cast("double") - F.lit(float(self.low))) / F.lit(self.wide)).cast("int")
        else:
            at = F.lit(0)
        return F.when(inside, F.least(at, F.lit(self.bin_count - 1)))

    def of(self, values: np.ndarray) -> np.ndarray:
        """The same in numpy, for checks: bins of the values inside the bounds."""
        v = values.astype(np.float32)
        v = v[(v >= self.low) & (v <= self.high)]
        if self.plain:
            at = ((v - self.low) / self.width).astype(np.int64)
        elif self.wide > 0:
            at = ((v.astype(np.float64) - float(self.low)) / self.wide).astype(np.int64)
        else:
            at = np.zeros(len(v), np.int64)
        return np.minimum(at, self.bin_count - 1)
