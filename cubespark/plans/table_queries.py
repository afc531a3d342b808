"""Queries over coordinates, listings and operation logs, on tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axes, layouts
from ..sources.tables import HEIGHT, WIDTH, table, vector_cube


def linear_axis_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of even, offset, uneven, equal, single and constant axes."""
    made = spark.range(200).select(F.explode(F.array(
        F.struct(F.lit("even").alias("axis"), (F.col("id") * 0.25 - 10.0).alias("value")),
        F.struct(F.lit("offset").alias("axis"), (F.col("id") * 0.5 + 3.0).alias("value")),
        F.struct(F.lit("uneven").alias("axis"), (F.col("id") * F.col("id") * 1.0).alias("value")),
        F.struct(F.lit("equal").alias("axis"), F.lit(7.0).alias("value")),
    )).alias("s"), "id").select("s.axis", F.col("id").alias("idx"), "s.value")
    prices = table(spark, sf_dir, "part").select(F.lit("prices").alias("axis"), F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    fit = axes.linear_fit(made.union(prices))
    rounded = [F.round(c, 6).alias(c) for c in ("increment", "reference_value", "reference_pixel")]
    return fit.select("axis", "uniform", *rounded, "nonuniform", "inexact")


def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand, the part whose price is closest to 1,200."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    return axes.nearest(parts, F.lit(1200.0), ["p_brand"])


def beams_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams of the cube's channels, stored as minor, pa, major in mixed case."""
    _, cube = vector_cube(spark, sf_dir)
    labels = spark.createDataFrame([(0, "Minor"), (1, "PA"), (2, "major")], "param int, label string")
    n = cube.length("spectral")
    cells = spark.range(n * 3).select(F.lit(0).alias("time"), (F.col("id") % n).cast("int").alias("channel"), F.lit(0).alias("polarization"), F.floor(F.col("id") / n).cast("int").alias("param"))
    value = F.when(F.col("param") == 2, 2.0 + F.col("channel")).when(F.col("param") == 0, 1.0 + F.col("channel") / 2).otherwise(F.col("channel") * 0.25)
    return axes.beams(cells.withColumn("value", value), labels)


def _op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed operations: each user is a layout, each kind of event a mode."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 7).alias("setting"),
        F.col("event_type").alias("mode"),
        (F.col("user_id") % 3).alias("users"),
        F.lit("t").alias("label"),
        F.lit("d").alias("dataset"),
        F.lit("m").alias("method"),
        F.when(F.col("event_id") % 97 == 0, "timeout").when(F.col("event_id") % 89 == 0, "error").otherwise("ok").alias("status"),
        (F.col("value") + 1.0).alias("seconds"),
        (F.col("event_id") * 1000).alias("logical_bytes"),
        (F.col("event_id") * 1.0).alias("t_start_s"),
        (F.col("event_id") + F.col("value")).alias("t_end_s"),
        (F.col("event_id") % 5 == 0).alias("shares_chunks"),
        "event_id",
    )


def sweep_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.summary(_op_log(spark, sf_dir), ["setting", "mode"])
    inf = float("inf")
    return found.select("setting", "mode", "ops", "errors", "timeouts", *[F.when(F.col(c) < inf, F.round(c, 6)).alias(c) for c in ("median_s", "p90_s", "min_s", "mib_s", "makespan_s")])


def first_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.first_touch_sample(_op_log(spark, sf_dir), ["setting", "mode"]).groupBy("mode").agg(F.count(F.lit(1)).alias("kept"), F.sum("event_id").alias("ids"))


def _mode_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.order_statistics(_op_log(spark, sf_dir).filter("status = 'ok'"), ["setting", "mode"], "seconds").select("setting", "mode", F.col("median").alias("seconds"))


def sweep_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode")).distinct().withColumn("weight", F.length("mode") * 1.0)
    return layouts.scores(_mode_times(spark, sf_dir), weights).select("setting", F.round("score", 6).alias("score"), F.round("worst", 6).alias("worst"), "rank")


def sweep_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that none beats in price without being larger."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return layouts.pareto(parts, ["p_retailprice", "p_size"])


def nearest_rank_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.order_statistics(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", "p90", "upper_median")


def checksum_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linestatus").alias("checksum"))
    return layouts.checksum_mismatches(rows, ["l_orderkey", "l_returnflag"])


def first_touch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "orders").filter("o_orderkey is not null").select(
        (F.col("o_custkey") % 16).alias("process"), F.col("o_orderkey").alias("op"),
        (F.col("o_orderkey") * 7 % 900).cast("int").alias("x0"), (F.col("o_custkey") * 5 % 900).cast("int").alias("y0"), (F.col("o_orderkey") % 11).cast("int").alias("z0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 2, "y1": F.col("y0") + 3, "z1": F.col("z0") + 1})
    return layouts.shared_chunks(boxes)


def late_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("player"), F.col("event_id").alias("frame"), (F.col("value") / 100).alias("took"))
    found = layouts.late_frames(frames, 5.0)
    return found.select("player", "frames", "late_frames", *[F.round(c, 9).alias(c) for c in ("late_max_s", "frame_first_s", "frame_median_s", "frame_max_s")])


def robust_noise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _ = vector_cube(spark, sf_dir)
    found = layouts.robust_noise(pixels.filter("not flagged"), ["channel"])
    return found.select("channel", *[F.round(c, 6).alias(c) for c in ("nan_fraction", "rms", "beyond")])


def noise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the noise measures over channels, and channels of nothing but NaN."""
    pixels, _ = vector_cube(spark, sf_dir)
    told = layouts.noise_summary(layouts.robust_noise(pixels.filter("not flagged"), ["channel"]))
    return told.select("channels", "all_nan_channels", *[F.round(c, 6).alias(c) for c in ("nan_fraction", "rms", "beyond")])


def nan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks one channel deep, and those of nothing but NaN."""
    pixels, cube = vector_cube(spark, sf_dir)
    return layouts.nan_chunks(pixels, cube.chunk | {"spectral": 1}, -(-WIDTH // cube.chunk["x"]) * -(-HEIGHT // cube.chunk["y"]))


def read_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 1.0).alias("pixels"), (F.col("l_linenumber") * 1.0).alias("chunks"), (F.col("l_extendedprice") / 1000).alias("seconds"))
    return layouts.model_fit(rows).select(F.round("pixels_per_s", 6).alias("pixels_per_s"), F.round("seconds_per_chunk", 6).alias("seconds_per_chunk"))


def pixel_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that differ from a copy in which one row of one channel was changed."""
    pixels, _ = vector_cube(spark, sf_dir)
    copy = pixels.withColumn("value", F.when((F.col("channel") == 2) & (F.col("y") == 9), F.col("value") + 1).otherwise(F.col("value")))
    found = layouts.differing_pixels(pixels, copy, ["channel", "y", "x"])
    return found.groupBy("channel", "y").agg(F.count(F.lit(1)).alias("pixels"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of the cube beside those of copies: dealt anew, with two values exchanged, without one row of the plane."""
    pixels, _ = vector_cube(spark, sf_dir)
    places = ["channel", "y", "x"]
    exchanged = pixels.withColumn("x", F.when(F.col("y") != 4, F.col("x")).when(F.col("x") == 1, 2).when(F.col("x") == 2, 1).otherwise(F.col("x")))
    copies = {"dealt": pixels.repartition(13, "x", "channel"), "exchanged": exchanged, "shorter": pixels.filter("y <> 4")}
    out = layouts.fingerprint(pixels, places)
    for name, copy in copies.items():
        one = layouts.fingerprint(copy, places).first()  # one number
        out = out.withColumn(name, F.col("fingerprint") == F.lit(one["fingerprint"]))
    return out.select("pixels", *copies)


def storage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a run of chunks and the depth rule over sizes of parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 1).alias("c"))
    run = layouts.chunk_run_bytes(F.lit(512), F.lit(300), F.col("c"), F.col("c") + 3, F.col("c") * (F.col("c") + 3) * 4)
    return p.select("p_partkey", run.cast("bigint").alias("run_bytes"), F.round(layouts.depth_rule(F.col("c") * F.col("c"), F.lit(256), F.lit(512 * 300)), 9).alias("depth"))
