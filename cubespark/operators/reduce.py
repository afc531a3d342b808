"""Statistics of regions by channel, all in one scan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.pixels import good, or_nan
from ..model import CubeMeta, PlaneSelection, Statistic
from .regions import contained
from .selection import selected_planes

KEYS = ["region_id", "sel_channel"]


def aggregates(which: Statistic, v: str = "v", rows: Column | None = None) -> list[Column]:
    """Aggregates over doubles v, null where a pixel is not good; rows: how many pixels a row stands for (1).

    The spread is the engine's population variance times the count: its moments are centred in every
    task and merge as centred ones (Chan, Golub, LeVeque), so one pass is enough.
    """
    c = F.col(v)
    made = {
        "num_pixels": F.count(c),
        "nan_count": (F.count(F.lit(1)) if rows is None else F.coalesce(F.sum(rows), F.lit(0))) - F.count(c),
        "sum": F.coalesce(F.sum(c), F.lit(0.0)),
        "sum_sq": F.coalesce(F.sum(c * c), F.lit(0.0)),
        "min": or_nan(F.min(c)),
        "max": or_nan(F.max(c)),
        "sum_sq_dev": F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)),
    }
    return [made[n].cast("double").alias(n) for n in which.names()]


def spectral_reduce(pixels: DataFrame, cube: CubeMeta, runs: DataFrame, region_ids: DataFrame, planes: PlaneSelection, statistics: Statistic = Statistic.all(), mask: bool = True, most_runs: int | None = None) -> DataFrame:
    """(region_id, sel_channel, *statistics) for every region and selected channel, those without good pixels included.

    Pixels are scanned once for all regions and statistics.  The grid of regions and channels (what is
    asked for: a row of the result each) joins the pixels before they are aggregated, as rows that
    count for nothing, so there is one shuffle and no join behind it.
    """
    if not statistics:
        raise CubeError("invalid_argument", "no statistic is asked for")
    which = statistics.implied()
    chosen = selected_planes(pixels, cube, planes)
    value = good(F.col("value"), F.col("flagged")) if mask else good(F.col("value"))
    values = contained(chosen.select("sel_channel", "x", "y", value.alias("v")), runs, most_runs=most_runs).select(*KEYS, "v", F.lit(1).alias("n"))
    grid = region_ids.select("region_id", F.explode(F.sequence(F.lit(0), F.lit(planes.channels.count - 1))).alias("sel_channel"), F.lit(None).cast("double").alias("v"), F.lit(0).alias("n"))
    return values.unionByName(grid).groupBy(*KEYS).agg(*aggregates(which, rows=F.col("n")))


def mean_and_variance(stats: DataFrame) -> DataFrame:
    """stats with mean (null without pixels) and variance (null with fewer than two)."""
    n = F.col("num_pixels")
    return stats.withColumns({"mean": F.when(n > 0, F.col("sum") / n), "variance": F.when(n > 1, F.col("sum_sq_dev") / (n - 1))})


@dataclass(frozen=True)
class Block:
    """A block of results on the driver: statistics by region and channel, as many as are asked for."""

    first_channel: int
    carried: tuple[str, ...]
    values: dict[tuple[int, str], np.ndarray]
    channels: int

    #: What a statistic reads as where it was not carried: that of no pixels.
    NOTHING = {"min": float("nan"), "max": float("nan")}

    @classmethod
    def of(cls, stats: DataFrame, first_channel: int = 0) -> Block:
        names = tuple(s.name for s in Statistic if s.name in stats.columns)
        table = stats.select(*KEYS, *names).toArrow().sort_by([(k, "ascending") for k in KEYS])
        region, channel = (table.column(k).to_numpy() for k in KEYS)
        channels = len(np.unique(channel))
        found = {}
        for n in names:
            column = table.column(n).to_numpy()
            for r in np.unique(region).tolist():
                found[r, n] = column[region == r]
        return cls(first_channel, names, found, channels)

    def carries(self, statistic: Statistic) -> bool:
        return statistic.name in self.carried

    def series(self, region_id: int, statistic: Statistic) -> np.ndarray:
        """The statistic by channel; of one that was not carried, what it is without pixels."""
        found = self.values.get((region_id, statistic.name))
        return np.full(self.channels, self.NOTHING.get(statistic.name, 0.0)) if found is None else found

    def totals(self, region_id: int, channel: int) -> dict[str, float]:
        """All statistics of a channel, by place in the block."""
        if not 0 <= channel < self.channels:
            raise CubeError("invalid_slice", f"channel {channel} of a block of {self.channels}")
        return {s.name: float(self.series(region_id, s)[channel]) for s in Statistic}
