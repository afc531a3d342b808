"""Any table of equal vectors as a dense cube of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Axis, CubeMeta, Range
from ..session import reachable

WIDTH, HEIGHT = 64, 25
CHUNK = {"x": 16, "y": 5, "spectral": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vector_pixels(vectors: DataFrame, channels: Range | None = None, x: Range | None = None) -> DataFrame:
    """Vectors (vec_id, embedding) as pixels: x along the vector, 25 vectors a plane; every seventh channel from 3 on is a hole of NaN.

    channels, x: bounds of what is read (their strides are left to the operators): the former become
    bounds of vec_id, which the scan prunes by, the latter the part of each vector that is unfolded.
    """
    if channels is not None:
        vectors = vectors.filter(F.col("vec_id").between(channels.start * HEIGHT, (channels.last + 1) * HEIGHT - 1))
    first = 0 if x is None else x.start
    part = F.col("embedding") if x is None else F.slice("embedding", x.start + 1, x.last - x.start + 1)
    at = vectors.select("vec_id", F.posexplode(part).alias("place", "v")).select("vec_id", (F.col("place") + first).alias("x"), "v")
    channel = F.floor(F.col("vec_id") / HEIGHT).cast("int")
    y = (F.col("vec_id") % HEIGHT).cast("int")
    return at.select(
        F.lit(0).alias("time"),
        F.lit(0).alias("polarization"),
        channel.alias("channel"),
        y.alias("y"),
        F.col("x").cast("int").alias("x"),
        F.when(channel % 7 == 3, F.lit(float("nan")).cast("float")).otherwise(F.col("v").cast("float")).alias("value"),
        ((F.col("x") + y) % 3 == 0).alias("flagged"),
    )


def vector_count(spark: SparkSession, sf_dir: str) -> int:
    """How many vectors there are, from the files' footers.  They are numbered from 0 without gaps, so the last plane may end early, after any of its rows."""
    return table(spark, sf_dir, "embeddings").count()


def vector_cube(spark: SparkSession, sf_dir: str, **bounds: Range) -> tuple[DataFrame, CubeMeta]:
    """The pixels and their description: as many channels as the vectors fill or begin."""
    vectors = table(spark, sf_dir, "embeddings")
    channels = -(-vector_count(spark, sf_dir) // HEIGHT)
    axes = (Axis("l", "x", WIDTH, 4), Axis("m", "y", HEIGHT, 3), Axis("frequency", "spectral", channels, 1), Axis("polarization", "polarization", 1, 2), Axis("time", "time", 1, 0))
    return vector_pixels(vectors, **bounds), CubeMeta(axes, CHUNK)


def of_vectors(pixels: DataFrame, vectors: int) -> DataFrame:
    """Pixels that a vector holds: a store of the cube has whole planes, while the last one of the table may end early."""
    return pixels.filter(F.col("channel").cast("bigint") * HEIGHT + F.col("y") < vectors)
