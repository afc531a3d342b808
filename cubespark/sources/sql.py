"""The engine by SQL text: images as views, and rasters as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..model import Region
from ..operators.regions import raster_runs
from ..session import reachable
from .cube import CubeSource, load


@udtf(returnType="y: int, x_begin: int, x_end: int")
class RegionRuns:
    """region_runs(x0, y0, width, height, mask): the runs of one region."""

    def eval(self, x0: int, y0: int, width: int, height: int, mask: bytes):
        for y, a, b in raster_runs(Region(0, x0, y0, width, height, bytes(mask) if mask else None)).tolist():
            yield y, a, b


def register(spark: SparkSession, path: str | None = None, image: str | None = None, view: str = "pixels") -> None:
    """The format ``cube``, the function ``region_runs`` and, with a path, a view of an image's pixels."""
    reachable(spark).dataSource.register(CubeSource)
    spark.udtf.register("region_runs", RegionRuns)
    if path:
        load(spark, path, image).createOrReplaceTempView(view)
