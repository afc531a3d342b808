"""Expressions on the sky and on profiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def orthographic(l: Column, m: Column, longitude: float, latitude: float) -> tuple[Column, Column]:  # noqa: E741
    """(longitude, latitude) in radians of direction cosines l, m about a reference: the SIN projection undone.

    Beyond the sphere the third cosine is 0.
    """
    n = F.sqrt(F.greatest(F.lit(0.0), 1 - l * l - m * m))
    sin, cos = F.lit(math.sin(latitude)), F.lit(math.cos(latitude))
    return F.lit(longitude) + F.atan2(l, n * cos - m * sin), F.asin(m * cos + n * sin)


def cartesian(longitude: Column, latitude: Column, radius: Column) -> tuple[Column, Column, Column]:
    return radius * F.cos(latitude) * F.cos(longitude), radius * F.cos(latitude) * F.sin(longitude), radius * F.sin(latitude)


def gaussian(x: np.ndarray, width: float) -> np.ndarray:
    """A peak of 1 with a full width at half maximum."""
    return np.exp(-4 * math.log(2) * (x / width) ** 2)


_erf = np.frompyfunc(math.erf, 1, 1)


def double_horn(x: np.ndarray, width: float, edge: float, dip: float) -> np.ndarray:
    """The profile of a turning disc: a box with edges that fall off like error functions, dipped in the middle."""
    step = lambda d: _erf(d / (math.sqrt(2) * edge)).astype(float)
    box = (step(x + width / 2) - step(x - width / 2)) / 2
    return box * (1 - dip * (1 - np.minimum(1.0, (2 * x / width) ** 2)))
