"""Cubes by formula and by seeded noise."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import double_horn, gaussian
from ..model import Axis, CubeMeta
from ..session import reachable
from .cube import ARROW, SCHEMA

TILE = 128


def formula(spark: SparkSession, cube: CubeMeta, value: Callable[..., Column], flagged: Callable[..., Column] | None = None, partitions: int | None = None) -> DataFrame:
    """The pixel relation of value(x, y, channel, polarization, time)."""
    sizes = [cube.length(r) for r in ("x", "y", "spectral", "polarization", "time")]
    total = int(np.prod(sizes, dtype=object))
    rows = spark.range(0, total, 1, partitions) if partitions else spark.range(total)
    columns, rest = [], F.col("id")
    for n in sizes:
        columns.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    x, y, c, p, t = columns
    named = rows.select(t.alias("time"), p.alias("polarization"), c.alias("channel"), y.alias("y"), x.alias("x"))
    at = [F.col(n) for n in ("x", "y", "channel", "polarization", "time")]
    return named.select("time", "polarization", "channel", "y", "x", value(*at).cast("float").alias("value"), (flagged(*at) if flagged else F.lit(False)).alias("flagged"))


def cube_of(nx: int, ny: int, channels: int, polarizations: int = 1, times: int = 1, chunk: dict[str, int] | None = None) -> CubeMeta:
    return CubeMeta((Axis("l", "x", nx, 3), Axis("m", "y", ny, 4), Axis("frequency", "spectral", channels, 1), Axis("polarization", "polarization", polarizations, 2), Axis("time", "time", times, 0)), chunk or {})


@dataclass(frozen=True)
class Sky:
    """What a synthetic cube holds besides noise; all of it follows from the seed and the shape."""

    seed: int = 0
    sources: int = 5
    points: int = 0
    extended: int = 0
    rms: float = 1.0
    bad_share: float = 0.05
    fill: float | None = 0.8

    def lines(self, nx: int, ny: int, channels: int) -> list[tuple]:
        """Line sources: place, sizes, turn, peak, centre and width in channels, and the dip of a double horn (0: one peak)."""
        rnd, out = np.random.default_rng([self.seed, 1]), []
        for _ in range(self.sources):
            horn = rnd.uniform() < 0.5
            out.append((rnd.uniform(0, nx), rnd.uniform(0, ny), rnd.uniform(1, 4), rnd.uniform(0.3, 1), rnd.uniform(0, math.pi), rnd.uniform(5, 20) * self.rms, rnd.uniform(0, channels), rnd.uniform(1, max(2, channels / 10)), rnd.uniform(0.2, 0.5) if horn else 0.0))
        return out

    def continuum(self, nx: int, ny: int) -> list[tuple]:
        """Sources in every channel: place, sizes, turn, peak and spectral index; extended ones are large and faint."""
        rnd, out = np.random.default_rng([self.seed, 5]), []
        for i in range(self.points + self.extended):
            far = i >= self.points
            out.append((rnd.uniform(0, nx), rnd.uniform(0, ny), rnd.uniform(20, 60) if far else rnd.uniform(1.5, 4), rnd.uniform(0.3, 1) if far else 1.0, rnd.uniform(0, math.pi), self.rms * (rnd.uniform(0.5, 3) if far else rnd.uniform(1, 100)), rnd.normal(-0.7, 0.3)))
        return out

    def ripple(self, channels: int) -> np.ndarray:
        """The noise of each channel: a slow wave and a jitter."""
        return self.rms * (1 + 0.1 * np.sin(np.arange(channels) / 7.0) + np.random.default_rng([self.seed, 2]).normal(0, 0.02, channels))

    def bad(self, channels: int) -> dict[int, tuple[float, float] | None]:
        """Flagged channels, in runs of lengths even in their logarithm: whole (None), or beyond a line (its angle and distance)."""
        rnd, out, wanted = np.random.default_rng([self.seed, 3]), {}, round(self.bad_share * channels)
        while len(out) < wanted:
            n = min(int(2 ** rnd.uniform(0, 7)), wanted - len(out))
            start = int(rnd.integers(0, channels - n + 1))
            half = (rnd.uniform(0, 2 * math.pi), rnd.uniform(-0.3, 0.3)) if rnd.uniform() < 0.5 else None
            out |= dict.fromkeys(range(start, start + n), half)
        return out


def _blob(x: np.ndarray, y: np.ndarray, at: tuple) -> np.ndarray:
    cx, cy, major, ratio, turn = at
    dx, dy = x - cx, y - cy
    u, v = dx * math.cos(turn) + dy * math.sin(turn), dy * math.cos(turn) - dx * math.sin(turn)
    return np.exp(-((u / major) ** 2 + (v / (major * ratio)) ** 2) / 2)


def line_cube(spark: SparkSession, nx: int, ny: int, channels: int, seed: int = 0, sources: int = 5, rms: float = 1.0, sky: Sky | None = None) -> DataFrame:
    """Noise in tiles seeded by their place, a rounded footprint outside which is NaN, runs of channels flagged in whole or on one
    side, line sources with one peak or two horns, and continuum sources.

    A tile's pixels depend on the seed and its place alone, not on the partitioning.
    """
    sky = sky or Sky(seed, sources, rms=rms)
    lines, steady, noise_of, bad = sky.lines(nx, ny, channels), sky.continuum(nx, ny), sky.ripple(channels), sky.bad(channels)
    # |u|^4 + |v|^4 <= R^4 holds 4 R^2 times this share of the plane's square.
    share = math.gamma(1.25) ** 2 / math.gamma(1.5)
    reach = None if sky.fill is None else math.sqrt(sky.fill / share)

    def tiles(batches):
        for batch in batches:
            for tx, ty, c in zip(*(batch.column(n).to_pylist() for n in ("tx", "ty", "channel"))):
                w, h = min(TILE, nx - tx * TILE), min(TILE, ny - ty * TILE)
                found = np.random.default_rng([sky.seed, 4, tx, ty, c]).normal(0, noise_of[c], (TILE, TILE))[:h, :w]
                y, x = np.mgrid[ty * TILE : ty * TILE + h, tx * TILE : tx * TILE + w]
                for *at, peak, centre, wide, dip in lines:
                    d = np.array([c - centre])
                    found += peak * _blob(x, y, at) * (double_horn(d, wide, max(wide / 10, 0.5), dip) if dip else gaussian(d, wide))
                for *at, peak, index in steady:
                    found += peak * _blob(x, y, at) * (1 + c / max(1, channels)) ** index
                u, v = 2 * (x + 0.5) / nx - 1, 2 * (y + 0.5) / ny - 1
                if reach is not None:
                    found = np.where(u**4 + v**4 > reach**4, np.nan, found)
                half = bad.get(c)
                flagged = np.full(found.shape, c in bad) if half is None else u * math.cos(half[0]) + v * math.sin(half[0]) > half[1]
                n = found.size
                same = lambda k: np.full(n, k, np.int32)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (same(0), same(0), same(c), y.ravel().astype(np.int32), x.ravel().astype(np.int32), found.astype(np.float32).ravel(), flagged.ravel())], schema=ARROW)

    across, down = -(-nx // TILE), -(-ny // TILE)
    keys = reachable(spark).range(across * down * channels).select((F.col("id") % across).cast("int").alias("tx"), (F.floor(F.col("id") / across) % down).cast("int").alias("ty"), F.floor(F.col("id") / (across * down)).cast("int").alias("channel"))
    return keys.mapInArrow(tiles, SCHEMA)
