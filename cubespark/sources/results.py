"""Benchmark results as versioned CSV, resumed runs, and raw sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CubeError
from ..operators.layouts import MIDDLE, P90, by_rank
from . import codecs as cc
from .images import Dataset

VERSION = "# layout results 1"
SCHEMA = """run_id string, run_key string, label string, dataset string, image_id string, shape string, chunk_shape string, shard_shape string,
    chunk_decoded_bytes bigint, codec string, mode string, method string, setting string, users int, seed bigint, ops int, trial int, process_index int,
    op_index int, position string, overlap boolean, shares_chunks boolean, status string, error string, seconds double, t_start_s double, t_end_s double,
    elements bigint, logical_bytes bigint, storage_read_bytes bigint, checksum string, frames_played int, frame_first_s double, frame_median_s double,
    frame_max_s double, late_frames int, late_max_s double, attempt int"""
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def write_results(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).csv(folder)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All rows; a trial that was tried again keeps its last attempt only."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(SCHEMA).csv(folder)
    last = F.max("attempt").over(Window.partitionBy("run_key", "trial"))
    return rows.withColumn("last", last).filter(F.col("attempt").eqNullSafe(F.col("last"))).drop("last")


def complete_trials(rows: DataFrame) -> DataFrame:
    """(run_key, trial) of which every operation of every process is there."""
    found = rows.groupBy("run_key", "trial").agg(F.count_distinct("process_index", "op_index").alias("have"), F.max(F.col("users") * F.col("ops")).alias("wanted"))
    return found.filter("have = wanted").select("run_key", "trial")


def chunk_summary(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """By group: median and p90 of first touches (null with fewer than ``least``), share of late frames, frame medians."""
    marked = rows.withColumn("first_s", F.when(~F.coalesce("shares_chunks", F.lit(False)) & (F.col("status") == "ok"), F.col("seconds")))
    inner = {"firsts": F.count("first_s"), "late": F.sum("late_frames"), "played": F.sum(F.col("frames_played") - 1)}
    outer = {"first_touches": F.sum("firsts"), "late": F.sum("late"), "played": F.sum("played")}
    timed = by_rank(marked, keys, "first_s", {"low": MIDDLE[0], "high": MIDDLE[1], "p90": P90}, inner, outer)
    frames = by_rank(rows, keys, "frame_median_s", {"frame_low": MIDDLE[0], "frame_high": MIDDLE[1]})
    same = None
    for k in keys:
        one = timed[k].eqNullSafe(frames[k])
        same = one if same is None else same & one
    enough = F.col("first_touches") >= least
    return timed.join(frames, same).select(
        *[timed[k] for k in keys],
        F.when(enough, (F.col("low") + F.col("high")) / 2).alias("median_s"),
        F.when(enough, F.col("p90")).alias("p90_s"),
        "first_touches",
        (F.col("late") / F.col("played")).alias("late_share"),
        ((F.col("frame_low") + F.col("frame_high")) / 2).alias("frame_median_s"),
    )


def ordered_fingerprint(values: np.ndarray) -> int:
    """FNV-1a over the bytes of an ordered run of values; every NaN counts as the one quiet NaN."""
    v = np.where(np.isnan(values), np.array(np.nan, values.dtype), values).astype(values.dtype.newbyteorder("<"))
    h = FNV_OFFSET
    for b in v.tobytes():
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def ordered_values(pixels: DataFrame, kind: str = "<f4") -> Iterator[bytes]:
    """Values in logical order as bytes, about a million at a time, partition after partition."""
    ordered = pixels.orderBy("time", "polarization", "channel", "y", "x").select("value")

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 18):
                values = batch.column(0).slice(at, 1 << 18).to_numpy(zero_copy_only=False).astype(kind)
                yield pa.RecordBatch.from_pydict({"raw": pa.array([values.tobytes()], pa.binary())})

    for row in ordered.mapInArrow(packed, "raw binary").toLocalIterator(prefetchPartitions=True):
        yield row[0]


def write_raw(pixels: DataFrame, out) -> int:
    """float32 values in logical order to a binary stream; returns how many."""
    n = 0
    for part in ordered_values(pixels):
        out.write(part)
        n += len(part) // 4
    return n


def compression_ratio(spark: SparkSession, dataset: Dataset, node: str) -> float | None:
    """Decoded over stored bytes of the chunks that are there; of shards, the chunks that their index lists."""
    a = dataset.store.array(node)
    size = cc.dtype_of(a.data_type).itemsize
    root, meta = str(dataset.store.root / node), a
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(~F.col("path").endswith("zarr.json"))
    if a.shard is None:
        n = files.agg(F.count(F.lit(1)), F.sum("length")).first()
        return None if not n[0] else n[0] * int(np.prod(a.chunk)) * size / n[1]

    def listed(batches):
        packer = next(c["configuration"] for c in meta.codecs if c["name"] == "sharding_indexed")
        grid = tuple(s // i for s, i in zip(meta.shard, meta.chunk))
        for batch in batches:
            out = []
            for raw in batch.column("content").to_pylist():
                inner = packer.get("index_codecs") or cc._index_codecs(packer)
                n = 16 * int(np.prod(grid)) + 4 * sum(c["name"] == "crc32c" for c in inner)
                index = cc.decode(raw[-n:], inner, (*grid, 2), np.dtype("<u8"), 0)
                there = index[..., 0] != cc.MISSING
                out.append((int(there.sum()), int(index[..., 1][there].sum())))
            yield pa.RecordBatch.from_pydict({"chunks": [x[0] for x in out], "bytes": [x[1] for x in out]})

    n = files.select("content").mapInArrow(listed, "chunks bigint, bytes bigint").agg(F.sum("chunks"), F.sum("bytes")).first()
    return None if not n[0] else n[0] * int(np.prod(a.chunk)) * size / n[1]


def refuse_overwrite(target: str, *inputs: str) -> None:
    """Outputs that are among the inputs are refused."""
    if target in inputs:
        raise CubeError("invalid_argument", f"{target} is one of the inputs")
