"""Regions of the plane: runs of their rasters, containment, occupancy of chunks, scan tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CubeError
from ..model import MOST_INCIDENCES, MOST_REGIONS, CubeMeta, Region

RUNS = "region_id int, y int, x_begin int, x_end int"


def raster_runs(region: Region) -> np.ndarray:
    """Rows (y, x_begin, x_end) of the selected pixels of a region, ends exclusive."""
    if not region.mask:
        y = np.arange(region.y0, region.y0 + region.height)
        return np.stack([y, np.full_like(y, region.x0), np.full_like(y, region.x0 + region.width)], axis=1)
    inside = np.zeros((region.height, region.width + 2), np.int8)
    inside[:, 1:-1] = np.frombuffer(region.mask, np.uint8).reshape(region.height, region.width) != 0
    change = np.diff(inside, axis=1)
    y, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    return np.stack([y + region.y0, begin + region.x0, end + region.x0], axis=1)


def region_table(spark: SparkSession, regions: list[Region], cube: CubeMeta) -> DataFrame:
    """The regions, each checked against the plane."""
    if not 1 <= len(regions) <= MOST_REGIONS:
        raise CubeError("invalid_argument", f"{len(regions)} regions")
    rows = [(r.region_id, r.x0, r.y0, r.width, r.height, r.mask) for r in (r.placed(cube) for r in regions)]
    return spark.createDataFrame(rows, "region_id int, x0 int, y0 int, width int, height int, mask binary")


def runs_of(regions: DataFrame) -> DataFrame:
    """Runs of every region's selected pixels; rasters are decoded where they lie, a region at a time."""

    def decoded(batches):
        schema = pa.schema([("region_id", pa.int32()), ("y", pa.int32()), ("x_begin", pa.int32()), ("x_end", pa.int32())])
        for batch in batches:
            for row in batch.to_pylist():
                found = raster_runs(Region(row["region_id"], row["x0"], row["y0"], row["width"], row["height"], row["mask"])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["region_id"], np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], schema=schema)

    return regions.mapInArrow(decoded, RUNS)


def most_runs(regions: list[Region]) -> int:
    """A bound on how many runs the regions have: one a line of a box, one for every second place of a raster."""
    return sum(r.height * (-(-r.width // 2) if r.mask else 1) for r in regions)


def islands(selected: DataFrame) -> DataFrame:
    """Runs of a table of selected pixels (region_id, y, x), by SQL alone."""
    line = Window.partitionBy("region_id", "y").orderBy("x")
    return (
        selected.select("region_id", "y", "x", (F.col("x") - F.row_number().over(line)).alias("island"))
        .groupBy("region_id", "y", "island")
        .agg(F.min("x").alias("x_begin"), (F.max("x") + 1).alias("x_end"))
        .drop("island")
    )


def contained(pixels: DataFrame, runs: DataFrame, broadcast_rows: int = 1 << 20, most_runs: int | None = None) -> DataFrame:
    """Every pixel once for each region that selects it.

    An equi-join on y with the run's bounds behind it.  Runs are broadcast only if a bound that the
    caller knows, or else counting them, says that there are few; otherwise both sides are also cut in
    blocks of x, so that a row of the plane is no hot key.
    """
    few = (runs.limit(broadcast_rows + 1).count() if most_runs is None else most_runs) <= broadcast_rows
    bounds = (F.col("x") >= F.col("x_begin")) & (F.col("x") < F.col("x_end"))
    if few:
        return pixels.join(F.broadcast(runs.withColumnRenamed("y", "run_y")), (F.col("y") == F.col("run_y")) & bounds).drop("run_y", "x_begin", "x_end")
    block = 256
    cut = runs.withColumn("x_block", F.explode(F.sequence(F.floor(F.col("x_begin") / block), F.floor((F.col("x_end") - 1) / block))))
    keyed = pixels.withColumn("x_block", F.floor(F.col("x") / block))
    return keyed.join(cut, ["y", "x_block"]).filter(bounds).drop("x_block", "x_begin", "x_end")


def occupancy(runs: DataFrame, chunk_x: int, chunk_y: int) -> DataFrame:
    """(region_id, cx, cy): the chunks in which each region selects a pixel."""
    cx = F.explode(F.sequence(F.floor(F.col("x_begin") / chunk_x).cast("int"), F.floor((F.col("x_end") - 1) / chunk_x).cast("int")))
    return runs.select("region_id", F.floor(F.col("y") / chunk_y).cast("int").alias("cy"), cx.alias("cx")).distinct().select("region_id", "cx", "cy")


def chunk_index(occupied: DataFrame, most: int = MOST_INCIDENCES) -> DataFrame:
    """(cx, cy, regions): for each occupied chunk the ascending regions."""
    if occupied.limit(most + 1).count() > most:
        raise CubeError("invalid_argument", f"regions and chunks meet more than {most} times")
    return occupied.groupBy("cx", "cy").agg(F.sort_array(F.collect_list("region_id")).alias("regions"))


def footprints(occupied: DataFrame, chunks_per_read: int) -> DataFrame:
    """(cx0, cx1, cy0, cy1), ends exclusive: rectangles of occupied chunks to read at once.

    Runs of chunks in a row that hold the same columns as the row before are one rectangle; wide runs are
    split to at most chunks_per_read columns, and rectangles to as many rows as leave a read that size.
    """
    if chunks_per_read < 1:
        raise CubeError("invalid_argument", "a read takes at least one chunk")
    cells = occupied.select("cx", "cy").distinct()
    row = Window.partitionBy("cy").orderBy("cx")
    runs = cells.withColumn("i", F.col("cx") - F.row_number().over(row)).groupBy("cy", "i").agg(F.min("cx").alias("cx0"), (F.max("cx") + 1).alias("cx1"))
    pieces = runs.select("cy", F.explode(F.sequence("cx0", F.col("cx1") - 1, F.lit(chunks_per_read))).alias("a"), "cx1")
    pieces = pieces.select("cy", F.col("a").alias("cx0"), F.least(F.col("a") + chunks_per_read, "cx1").alias("cx1"))
    same = Window.partitionBy("cx0", "cx1").orderBy("cy")
    stacks = pieces.withColumn("i", F.col("cy") - F.row_number().over(same)).groupBy("cx0", "cx1", "i").agg(F.min("cy").alias("cy0"), (F.max("cy") + 1).alias("cy1"))
    rows = F.greatest(F.lit(1), F.floor(F.lit(chunks_per_read) / (F.col("cx1") - F.col("cx0")))).cast("int")
    cut = stacks.select("cx0", "cx1", F.explode(F.sequence("cy0", F.col("cy1") - 1, rows)).alias("b"), "cy1", rows.alias("rows"))
    return cut.select("cx0", "cx1", F.col("b").alias("cy0"), F.least(F.col("b") + F.col("rows"), F.col("cy1")).alias("cy1"))


def occupied_pixels(pixels: DataFrame, occupied: DataFrame, chunk_x: int, chunk_y: int) -> DataFrame:
    """Pixels of occupied chunks only, by a semi-join on the chunk."""
    keyed = pixels.withColumns({"cx": F.floor(F.col("x") / chunk_x).cast("int"), "cy": F.floor(F.col("y") / chunk_y).cast("int")})
    return keyed.join(occupied.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").drop("cx", "cy")
