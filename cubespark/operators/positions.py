"""Benchmark workloads, and where their operations read: seeded positions that are the same everywhere.

Fixed values: the order of the modes and how many operations each makes by default; the golden-ratio
step and the two multipliers of SplitMix64.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import CubeError
from ..model import CubeMeta, Range
from .selection import whole

MODES = ("plane", "spectrum", "region", "cube_histogram", "open", "animation")
DEFAULT_OPS = {"plane": 16, "spectrum": 32, "region": 1, "cube_histogram": 1, "open": 8, "animation": 2}
METHODS = ("exact", "binned", "sampled")
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD = 1 << 64
#: Pools up to this size, and draws of over half a pool, are shuffled; others are drawn until new.
SHUFFLED = 1 << 20


def split_mix(seed: int) -> Iterator[int]:
    """SplitMix64: the mixed multiples of the golden step from the seed on."""
    state = seed % WORD
    while True:
        state = (state + GOLDEN) % WORD
        z = (state ^ state >> 30) * FIRST % WORD
        z = (z ^ z >> 27) * SECOND % WORD
        yield z ^ z >> 31


def bounded(word: int, bound: int) -> int:
    """A 64-bit word scaled to [0, bound): the high half of the product."""
    return 0 if bound <= 1 else word * bound >> 64


def stream_of(seed: int, mode: str, trial: int, salt: int) -> Iterator[int]:
    return split_mix(seed * GOLDEN + (MODES.index(mode) << 48) + (trial << 16) + salt)


def distinct_sample(words: Iterator[int], pool: int, count: int) -> list[tuple[int, bool]]:
    """count (value, overlap) of [0, pool): distinct while the pool lasts, in the same order again after; every prefix is the same whatever the count.

    overlap: the value is drawn more than once.
    """
    if not pool:
        return [(0, False)] * count
    if pool > SHUFFLED and 2 * count <= pool:
        seen: dict[int, None] = {}
        while len(seen) < count:
            seen.setdefault(bounded(next(words), pool))
        return [(v, False) for v in seen]
    moved: dict[int, int] = {}  # places whose value is not their own
    drawn = []
    for i in range(min(count, pool)):
        j = i + bounded(next(words), pool - i)
        drawn.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return [(drawn[i % pool], i >= pool or i + pool < count) for i in range(count)]


@dataclass(frozen=True)
class Operation:
    """What one operation reads: a box of pixels and channels of one polarization; overlap: another operation has the same position."""

    process: int
    op: int
    x: int = 0
    y: int = 0
    width: int = 0
    height: int = 0
    channel: int = 0
    channels: int = 0
    polarization: int = 0
    overlap: bool = False

    def ranges(self, cube: CubeMeta) -> dict[str, Range]:
        return whole(cube, x=Range(self.x, self.width), y=Range(self.y, self.height), spectral=Range(self.channel, self.channels), polarization=Range(self.polarization, 1), time=Range(0, 1))

    def chunks(self, cube: CubeMeta) -> dict[str, int]:
        """The box of chunks that it touches, ends exclusive, as ``layouts.shared_chunks`` takes it (the polarization within z)."""
        out = {}
        for name, role, a, n in (("x", "x", self.x, self.width), ("y", "y", self.y, self.height), ("z", "spectral", self.channel, self.channels)):
            size = cube.chunk_of(role)
            out |= {f"{name}0": a // size, f"{name}1": (a + n - 1) // size + 1}
        deep = self.polarization // cube.chunk_of("polarization") * -(-cube.length("spectral") // cube.chunk_of("spectral"))
        return out | {"z0": out["z0"] + deep, "z1": out["z1"] + deep}


@dataclass(frozen=True)
class Settings:
    """How operations are shaped: share of the plane of a region, frames of an animation, method and stride of a cube histogram."""

    fraction: float = 0.05
    frames: int = 32
    method: str = "exact"
    stride: int = 1

    def __post_init__(self):
        if not 0 < self.fraction <= 1 or self.frames < 1 or self.stride < 1 or self.method not in METHODS or (self.stride > 1 and self.method != "sampled"):
            raise CubeError("invalid_argument", f"{self}")

    @classmethod
    def histogram(cls, spelled: str) -> Settings:
        """exact, binned or sampled:N."""
        method, _, n = spelled.partition(":")
        if (method == "sampled") != bool(n) or n and not n.isdigit():
            raise CubeError("invalid_argument", f"histogram method {spelled!r}")
        return cls(method=method, stride=int(n or 1))


def plan(mode: str, cube: CubeMeta, seed: int = 1, trial: int = 0, processes: int = 1, ops: int | None = None, settings: Settings = Settings()) -> list[Operation]:
    """The operations of all processes of one trial, process by process.

    Positions come from one sequence for the trial, of which each process has a run, so that processes share
    none while there are enough; what else an operation needs comes from a second one.
    """
    if mode not in MODES or processes < 1:
        raise CubeError("invalid_argument", f"{processes} processes of mode {mode!r}")
    ops = DEFAULT_OPS[mode] if ops is None else ops
    w, h, channels, polarizations = (cube.length(r) for r in ("x", "y", "spectral", "polarization"))
    details = stream_of(seed, mode, trial, 2)
    draw = lambda bound: bounded(next(details), bound) if bound > 1 else 0
    full = Operation(0, 0, 0, 0, w, h, 0, channels)
    made: Callable[[int], Operation]
    if mode == "open":
        return [replace(full, process=p, op=k, channels=1) for p in range(processes) for k in range(ops)]
    if mode == "cube_histogram":
        base, out = draw(polarizations), []
        for p in range(processes):
            shared = processes > channels
            a, b = (p % channels, p % channels + 1) if shared else (channels * p // processes, channels * (p + 1) // processes)
            out += [replace(full, process=p, op=k, channel=a, channels=b - a, polarization=(base + k) % polarizations, overlap=shared or k >= polarizations) for k in range(ops)]
        return out
    if mode == "plane":
        pool, made = channels * polarizations, lambda v: replace(full, channel=v % channels, channels=1, polarization=v // channels)
    elif mode == "spectrum":
        pool, made = w * h, lambda v: replace(full, x=v % w, y=v // w, width=1, height=1, polarization=draw(polarizations))
    elif mode == "region":
        side = math.sqrt(settings.fraction)
        cells = [min(max(1, int(1 / side)), n) for n in (w, h)]
        size = [n // c for n, c in zip((w, h), cells)]
        box = [min(max(math.floor(side * n + 0.5), 1), s) for n, s in zip((w, h), size)]

        def made(v: int) -> Operation:
            x = v % cells[0] * size[0] + draw(size[0] - box[0] + 1)
            y = v // cells[0] * size[1] + draw(size[1] - box[1] + 1)
            return replace(full, x=x, y=y, width=box[0], height=box[1], polarization=draw(polarizations))

        pool = cells[0] * cells[1]
    else:
        frames = min(settings.frames, channels)
        runs = channels // frames
        each = channels // runs
        pool, made = runs * polarizations, lambda v: replace(full, channel=v % runs * each + draw(each - frames + 1), channels=frames, polarization=v // runs)
    sample = distinct_sample(stream_of(seed, mode, trial, 1), pool, processes * ops)
    # Every operation of the trial draws its details, in order, whichever process it is of.
    return [replace(made(v), process=i // ops, op=i % ops, overlap=again) for i, (v, again) in enumerate(sample)]


def operations(spark: SparkSession, planned: list[Operation], cube: CubeMeta) -> DataFrame:
    """The operations as rows, with the chunks that each touches."""
    rows = [tuple((o.__dict__ | o.chunks(cube)).values()) for o in planned]
    names = "process int, op int, x int, y int, width int, height int, channel int, channels int, polarization int, overlap boolean, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int"
    return spark.createDataFrame(rows, names)
