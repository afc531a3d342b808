"""Coordinates as tables: linear fits, nearest samples, beams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def nearest(samples: DataFrame, reference: Column, key: list[str] | None = None) -> DataFrame:
    """The sample (idx, value) closest to the reference in each group; the first of equals."""
    distance = F.abs(F.col("value") - reference)
    best = F.min_by(F.struct("idx", "value"), F.struct(distance, F.col("idx"))).alias("s")
    return samples.groupBy(*(key or [])).agg(best).select(*(key or []), "s.idx", "s.value")


def linear_fit(samples: DataFrame, axis: str = "axis", reference: Column | None = None) -> DataFrame:
    """A row for each axis of (axis, idx, value): uniform, increment, reference_value, reference_pixel, nonuniform, inexact.

    Samples are even if every spacing is within 1e-9 of the first, relative to the larger of the two and 1; then the increment is the whole
    span over the steps.  The reference pixel (1-based) is that of the closest sample if it is within
    1e-12 of the largest sample, else it is extrapolated.  Axes of fewer than two samples, or with one
    that is not finite, have none; equal first samples give an increment of 0 alone.
    """
    ref = F.lit(0.0) if reference is None else reference
    by = Window.partitionBy(axis).orderBy("idx")
    whole = Window.partitionBy(axis)
    v = F.col("value")
    spaced = samples.withColumns({"spacing": v - F.lag(v).over(by), "ref": ref.cast("double"), "place": F.row_number().over(by)})
    spaced = spaced.withColumn("first_spacing", F.max(F.when(F.col("place") == 2, F.col("spacing"))).over(whole))
    inc, sp = F.col("first_spacing"), F.col("spacing")
    off = (F.col("place") > 2) & (F.abs(sp - inc) > F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(inc), F.abs(sp)))
    found = spaced.groupBy(axis).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"),
        F.coalesce(F.bool_or(off), F.lit(False)).alias("off"),
        F.max("first_spacing").alias("inc"),
        F.min_by("value", "place").alias("first"),
        F.max_by("value", "place").alias("last"),
        F.max("ref").alias("ref"),
        F.max(F.abs(v)).alias("most"),
        F.min_by(F.struct("place", "value"), F.struct(F.abs(v - F.col("ref")), F.col("place"))).alias("near"),
    )
    able = (F.col("n") >= 2) & F.col("finite")
    fitted = able & (F.col("inc") != 0)
    uniform = fitted & ~F.col("off")
    increment = F.when(uniform & (F.col("n") > 2), (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(F.col("inc"))
    exact = F.abs(F.col("near.value") - F.col("ref")) <= F.lit(1e-12) * F.greatest(F.lit(1.0), F.col("most"))
    return found.select(
        axis,
        uniform.alias("uniform"),
        F.when(able, increment).alias("increment"),
        F.when(fitted, F.col("ref")).alias("reference_value"),
        F.when(fitted, F.when(exact, F.col("near.place").cast("double")).otherwise((F.col("ref") - F.col("first")) / increment + 1)).alias("reference_pixel"),
        ((F.col("n") >= 2) & (~F.col("finite") | (fitted & F.col("off")))).alias("nonuniform"),
        (fitted & ~exact).alias("inexact"),
    )


def beams(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(time, channel, polarization, major, minor, pa) from long cells (time, channel, polarization, param, value) and labels (param, label), matched whatever their case."""
    named = cells.join(labels, "param").withColumn("label", F.lower("label"))
    out = named.groupBy("time", "channel", "polarization").pivot("label", ["major", "minor", "pa"]).agg(F.first("value"))
    return out.orderBy("time", "channel", "polarization")
