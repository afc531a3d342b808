"""What a request says: ranges, axes, plane selections and statistics, checked before any job is submitted."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from .errors import CubeError

#: Roles of axes, and the columns of the pixel relation that hold their indices (logical order: x varies fastest).
ROLES = ("x", "y", "spectral", "polarization", "time")
COLUMN = {"x": "x", "y": "y", "spectral": "channel", "polarization": "polarization", "time": "time"}
LIMIT = 1 << 63


@dataclass(frozen=True)
class Range:
    """count indices from start on, stride apart."""

    start: int
    count: int
    stride: int = 1

    @property
    def last(self) -> int:
        return self.start + (self.count - 1) * self.stride

    def checked(self, length: int, axis: str = "axis") -> Range:
        """This range if it lies on an axis of that length; the stride of a single element is 1."""
        if self.stride <= 0 or self.count <= 0 or self.start < 0:
            raise CubeError("invalid_slice", f"{axis}: start {self.start}, count {self.count}, stride {self.stride}")
        if self.last >= min(length, LIMIT):
            raise CubeError("invalid_slice", f"{axis}: index {self.last} of a length of {length}")
        return Range(self.start, self.count, 1) if self.count == 1 else self

    def indices(self) -> range:
        return range(self.start, self.last + 1, self.stride)


@dataclass(frozen=True)
class Axis:
    """name; role (one of ROLES, or another); length; place in the stored order."""

    name: str
    role: str
    length: int
    storage_index: int = 0


def axis_index(axes: tuple[Axis, ...], role: str) -> int | None:
    """The first axis with the role, if any."""
    return next((i for i, a in enumerate(axes) if a.role == role), None)


@dataclass(frozen=True)
class CubeMeta:
    """Axes in logical order, and the shape of chunks by role."""

    axes: tuple[Axis, ...]
    chunk: dict[str, int] = field(default_factory=dict)
    shard: dict[str, int] | None = None
    compressor: str = ""

    def length(self, role: str) -> int:
        at = axis_index(self.axes, role)
        return 1 if at is None else self.axes[at].length

    def chunk_of(self, role: str) -> int:
        return self.chunk.get(role) or self.length(role)

    @property
    def fastest_spatial(self) -> str:
        """The spatial axis that varies fastest in the store: the one with the greater storage index."""
        return max(("x", "y"), key=lambda r: self.axes[axis_index(self.axes, r)].storage_index)

    def mapped(self) -> CubeMeta:
        """This cube if it can be reduced: x, y and spectral axes, and no other unknown axis longer than 1."""
        for role in ("x", "y", "spectral"):
            if axis_index(self.axes, role) is None:
                raise CubeError("not_implemented", f"the image has no {role} axis")
        for a in self.axes:
            if a.role not in ROLES and a.length != 1:
                raise CubeError("not_implemented", f"axis {a.name} has {a.length} elements and no known role", a.name)
        return self


@dataclass(frozen=True)
class PlaneSelection:
    """Channels by a range, one polarization, one time."""

    channels: Range
    polarization: int = 0
    time: int = 0

    def checked(self, cube: CubeMeta) -> PlaneSelection:
        channels = self.channels.checked(cube.length("spectral"), "spectral")
        for role, index in (("polarization", self.polarization), ("time", self.time)):
            if not 0 <= index < cube.length(role):
                raise CubeError("invalid_slice", f"{role} {index} of {cube.length(role)}")
        return PlaneSelection(channels, self.polarization, self.time)


class Statistic(enum.Flag):
    """Statistics of a region in a channel, in the order in which they are reported."""

    num_pixels = enum.auto()
    nan_count = enum.auto()
    sum = enum.auto()
    sum_sq = enum.auto()
    min = enum.auto()
    max = enum.auto()
    sum_sq_dev = enum.auto()

    @classmethod
    def all(cls) -> Statistic:
        return ~cls(0)

    def implied(self) -> Statistic:
        """With what it is computed from: a spread needs the count and the sum."""
        return self | Statistic.num_pixels | Statistic.sum if Statistic.sum_sq_dev in self else self

    def names(self) -> list[str]:
        return [s.name for s in Statistic if s in self]


@dataclass(frozen=True)
class Region:
    """A box of the plane, and a raster over it (row by row, x fastest; any byte but 0 selects) or none."""

    region_id: int
    x0: int
    y0: int
    width: int
    height: int
    mask: bytes | None = None

    def placed(self, cube: CubeMeta) -> Region:
        if self.width <= 0 or self.height <= 0 or self.x0 < 0 or self.y0 < 0 or self.x0 + self.width > cube.length("x") or self.y0 + self.height > cube.length("y"):
            raise CubeError("invalid_slice", f"region {self.region_id} is not within the plane")
        if self.mask and len(self.mask) != self.width * self.height:
            raise CubeError("invalid_argument", f"region {self.region_id} has a raster of {len(self.mask)} bytes for {self.width * self.height} pixels")
        return self


MOST_REGIONS, MOST_INCIDENCES, MOST_BINS = 1 << 20, 1 << 26, 1 << 20
