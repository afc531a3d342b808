"""Selections of pixels: hyperslabs, planes, spectra, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.pixels import folded
from ..model import COLUMN, CubeMeta, PlaneSelection, Range


def within(column: str, r: Range) -> Column:
    """The predicate of a checked range: bounds that a source can prune by, and the stride."""
    c = F.col(column)
    inside = (c >= r.start) & (c <= r.last)
    return inside if r.stride == 1 else inside & ((c - r.start) % r.stride == 0)


def hyperslab(pixels: DataFrame, cube: CubeMeta, ranges: dict[str, Range], mask: bool = True) -> DataFrame:
    """Pixels of one range for every axis, each with its indices in the selection as s_<column>; NaN where flagged if mask."""
    known = {a.role for a in cube.axes}
    if set(ranges) != known:
        raise CubeError("invalid_slice", f"ranges for {sorted(ranges)} and axes {sorted(known)}")
    out = pixels
    for a in cube.axes:
        out = out.filter(within(COLUMN[a.role], ranges[a.role].checked(a.length, a.name)))
    places = [((F.col(COLUMN[r]) - x.start) / x.stride).cast("int").alias(f"s_{COLUMN[r]}") for r, x in ranges.items()]
    value = folded(F.col("value"), F.col("flagged")) if mask else F.col("value")
    return out.select(*[COLUMN[a.role] for a in cube.axes], *places, value.alias("value"))


def elements(ranges: dict[str, Range]) -> int:
    """How many elements a selection has; more than a signed 64-bit number is refused."""
    total = 1
    for r in ranges.values():
        total *= r.count
    if total >= 1 << 63:
        raise CubeError("invalid_slice", "the selection has too many elements")
    return total


def whole(cube: CubeMeta, **changed: Range) -> dict[str, Range]:
    """Ranges over whole axes but for those named by role."""
    return {a.role: changed.get(a.role, Range(0, a.length)) for a in cube.axes}


def plane(pixels: DataFrame, cube: CubeMeta, channel: int, polarization: int = 0, time: int = 0, mask: bool = True) -> DataFrame:
    one = {"spectral": Range(channel, 1), "polarization": Range(polarization, 1), "time": Range(time, 1)}
    return hyperslab(pixels, cube, whole(cube, **one), mask)


def spectrum(pixels: DataFrame, cube: CubeMeta, x: int, y: int, polarization: int = 0, time: int = 0, mask: bool = True) -> DataFrame:
    one = {"x": Range(x, 1), "y": Range(y, 1), "polarization": Range(polarization, 1), "time": Range(time, 1)}
    return hyperslab(pixels, cube, whole(cube, **one), mask).orderBy("channel")


def selected_planes(pixels: DataFrame, cube: CubeMeta, planes: PlaneSelection) -> DataFrame:
    """Pixels of the selected planes with sel_channel, the index of the channel in the selection."""
    p = planes.checked(cube.mapped())
    at = ((F.col("channel") - p.channels.start) / p.channels.stride).cast("int")
    return pixels.filter((F.col("time") == p.time) & (F.col("polarization") == p.polarization) & within("channel", p.channels)).withColumn("sel_channel", at)


def sampled(pixels: DataFrame, every: int) -> DataFrame:
    """Every nth pixel on both spatial axes, counted from 0."""
    if every <= 0:
        raise CubeError("invalid_argument", f"a spatial sample of {every}")
    return pixels if every == 1 else pixels.filter((F.col("x") % every == 0) & (F.col("y") % every == 0))


def logical_order(pixels: DataFrame) -> DataFrame:
    """x fastest, then y, channel, polarization, time."""
    return pixels.orderBy("time", "polarization", "channel", "y", "x")


def first_of_chunks(cube: CubeMeta, ranges: dict[str, Range]) -> dict[str, Range]:
    """Of each axis the first selected element of every chunk touched; unchanged where the stride passes chunks."""
    out = {}
    for role, r in ranges.items():
        size = cube.chunk_of(role)
        if r.stride >= size or r.stride > 1:
            out[role] = r
            continue
        first, last = r.start // size, r.last // size
        out[role] = Range(r.start, 1) if first == last else Range(first * size, last - first + 1, size) if r.start % size == 0 else r
    return out


def world(pixels: DataFrame, coordinate: DataFrame, role: str = "spectral", name: str = "world") -> DataFrame:
    """Pixels with their world value of one axis; coordinate (idx, value) has a row for each index of the axis, so it is the small side."""
    c = coordinate.select(F.col("idx").alias(COLUMN[role]), F.col("value").alias(name))
    return pixels.join(c, COLUMN[role])


def linear_world(index: Column, crpix: float, cdelt: float, crval: float) -> Column:
    """The world value of an index by a linear description with 1-based reference pixel."""
    return F.lit(crval) + (index + 1 - F.lit(crpix)) * F.lit(cdelt)
