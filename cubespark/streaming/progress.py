"""Results that arrive while they are computed: prefixes, blocks of channels, snapshots, and stopping."""

from __future__ import annotations

import itertools
import math
import pickle
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.pixels import good
from ..model import CubeMeta, PlaneSelection, Range, Statistic
from ..operators.histogram import Provisional, provisional_bins, provisional_states
from ..operators.reduce import aggregates, spectral_reduce
from ..operators.regions import contained
from ..operators.selection import elements, hyperslab, whole, within
from ..sources.cube import HELD, MOST, SCHEMA, Span

MOST_BLOCK_BYTES, WATCHED_CHUNKS = 64 << 20, 16


@contextmanager
def stoppable(spark: SparkSession, cancelled: Callable[[], bool] | None = None, deadline_s: float | None = None, every_s: float = 0.05):
    """Jobs started inside end with ``cancelled`` once the callback says so or the time is over."""
    end = None if deadline_s is None else time.monotonic() + deadline_s
    over = lambda: bool(cancelled and cancelled()) or (end is not None and time.monotonic() >= end)
    if over():
        raise CubeError("cancelled", "stopped before it began")
    tag, done, hit = f"stoppable-{id(over)}", threading.Event(), threading.Event()

    def watch():
        while not done.wait(every_s):
            if over():
                hit.set()
                spark.interruptTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.addTag(tag)
    watcher.start()
    try:
        yield
        if over():
            hit.set()
            raise CubeError("cancelled", "stopped")
    except CubeError:
        raise
    except Exception as e:
        if hit.is_set():
            raise CubeError("cancelled", "stopped") from e
        raise
    finally:
        done.set()
        watcher.join()
        spark.removeTag(tag)


def cuts(count: int, chunk: int, most: int) -> list[tuple[int, int]]:
    """[0, count) in pieces of at most ``most`` elements that end on chunk bounds where they can."""
    step = max(1, most // chunk) * chunk if most >= chunk else most
    return [(a, min(a + step, count)) for a in range(0, count, step)]


def plan_pieces(cube: CubeMeta, ranges: dict[str, Range], most: int = WATCHED_CHUNKS, budget: int = MOST) -> list[dict[str, Range]]:
    """A selection as pieces in logical order, each of at most ``most`` chunks where that leaves whole planes.

    The cut is along the slowest axis whose every index (of the axes before it: one at a time) has few enough chunks,
    on chunk bounds; a plane is cut only if it alone would be over the budget, since its chunks are read again then.
    """
    order = list(reversed(cube.axes))
    many = {a.role: Span(ranges[a.role], cube.chunk_of(a.role)).count for a in order}
    wide = ranges["x"].count * ranges["y"].count * 4 * HELD > budget if {"x", "y"} <= set(ranges) else False
    last = max((i for i, a in enumerate(order) if wide or a.role not in ("x", "y")), default=0)
    below = [math.prod(many[a.role] for a in order[i + 1 :]) for i in range(len(order))]
    at = next((i for i in range(last) if below[i] <= most and ranges[order[i].role].count > 1), last)
    role, r = order[at].role, ranges[order[at].role]
    deep = max(1, cube.chunk_of(role) // r.stride)
    steps = cuts(r.count, deep, deep * max(1, most // below[at]))
    slower = [[Range(i, 1) for i in ranges[a.role].indices()] for a in order[:at]]
    out = []
    for fixed in itertools.product(*slower):
        one = ranges | {a.role: f for a, f in zip(order[:at], fixed)}
        out += [one | {role: Range(r.start + a * r.stride, b - a, r.stride)} for a, b in steps]
    return out


#: Where pixels come from: a table of them, or what reads those of a selection (``cube.reader``), so that no part reads them all.
Pixels = DataFrame | Callable[[dict[str, Range]], DataFrame]


def read_in_pieces(pixels: Pixels, cube: CubeMeta, ranges: dict[str, Range], progress: Callable[[int, int], bool], mask: bool = True, most: int = WATCHED_CHUNKS) -> Iterator[pa.Table]:
    """Pixels of a hyperslab in logical order as Arrow tables, piece by piece of at most ``most`` chunks.

    What was handed over is always a prefix; progress(elements so far, all) that returns False stops with ``cancelled``.
    """
    total, done = elements(ranges), 0
    for part in plan_pieces(cube, ranges, most):
        rows = hyperslab(pixels(part) if callable(pixels) else pixels, cube, part, mask).orderBy("time", "polarization", "channel", "y", "x").toArrow()
        done += rows.num_rows
        yield rows
        if not progress(done, total):
            raise CubeError("cancelled", f"stopped after {done} of {total} elements")


def block_channels(cube: CubeMeta, planes: PlaneSelection, emit_every: int, bytes_per_channel: int) -> int:
    """Channels a block: the hint, or what 64 MiB hold, whichever is less, in whole spectral chunks where it reaches one."""
    chunk = max(1, cube.chunk_of("spectral") // planes.channels.stride)
    n = max(1, min(emit_every or planes.channels.count, MOST_BLOCK_BYTES // max(1, bytes_per_channel), planes.channels.count))
    return n // chunk * chunk if n >= chunk else n


def reduce_in_blocks(pixels: Pixels, cube: CubeMeta, runs: DataFrame, region_ids: DataFrame, planes: PlaneSelection, statistics: Statistic, emit_every: int = 0, mask: bool = True) -> Iterator[tuple[int, DataFrame, float]]:
    """(first selected channel, its block of statistics, share done): blocks in channel order, each final once."""
    many = region_ids.count()
    step = block_channels(cube, planes, emit_every, 8 * 7 * many)
    for a in range(0, planes.channels.count, step):
        n = min(step, planes.channels.count - a)
        part = PlaneSelection(Range(planes.channels.start + a * planes.channels.stride, n, planes.channels.stride), planes.polarization, planes.time)
        some = pixels(whole(cube, spectral=part.channels, polarization=Range(part.polarization, 1), time=Range(part.time, 1))) if callable(pixels) else pixels
        block = spectral_reduce(some, cube, runs, region_ids, part, statistics, mask).withColumn("sel_channel", F.col("sel_channel") + a)
        yield a, block, (a + n) / planes.channels.count


def pixel_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Pixels that arrive as Parquet files in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(folder)


def running_statistics(stream: DataFrame, planes: PlaneSelection | None = None, runs: DataFrame | None = None, most_runs: int | None = None) -> DataFrame:
    """By channel, or by region and channel, the statistics of what has arrived: partial until the stream ends, each update a full result so far.

    Groups are channels (of each region), so the state is as large as what is asked for; moments merge as the engine's variance does.
    """
    chosen = stream if planes is None else stream.filter((F.col("time") == planes.time) & (F.col("polarization") == planes.polarization) & within("channel", planes.channels))
    keys, v = ["channel"], good(F.col("value"), F.col("flagged"))
    if runs is not None:
        keys, chosen = ["region_id", "channel"], contained(chosen, runs, most_runs=most_runs)
    return chosen.select(*keys, v.alias("v")).groupBy(*keys).agg(*aggregates(Statistic.all()))


def _handed(changed: DataFrame, expected, sink: Callable[[DataFrame, int], None], checkpoint: str):
    def each(batch: DataFrame, number: int) -> None:
        seen = F.col("num_pixels") + F.col("nan_count")
        full, wanted = expected(batch)
        sink(full.withColumns({"completeness": seen / wanted, "complete": seen >= wanted}).select(*batch.columns, "completeness", "complete"), number)

    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def stream_blocks(stream: DataFrame, pixels_per_channel: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the running statistics; each micro-batch hands the sink the channels that changed, with completeness and complete."""
    return _handed(running_statistics(stream), lambda batch: (batch, F.lit(pixels_per_channel)), sink, checkpoint)


def stream_region_blocks(stream: DataFrame, runs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, most_runs: int | None = None, short: tuple[int, int] | None = None):
    """The same by region and channel: complete once as many pixels have arrived as the region selects of a plane.

    short: a channel whose plane ends early, and how many rows it has.
    """

    def expected(batch: DataFrame):
        width = F.col("x_end") - F.col("x_begin")
        channel, rows = short or (-1, 0)
        wanted = runs.groupBy("region_id").agg(F.sum(width).alias("wanted"), F.sum(F.when(F.col("y") < rows, width).otherwise(0)).alias("of_short"))
        return batch.join(wanted, "region_id"), F.when(F.col("channel") == channel, F.col("of_short")).otherwise(F.col("wanted"))

    return _handed(running_statistics(stream, runs=runs, most_runs=most_runs), expected, sink, checkpoint)


def histogram_snapshots(stream: DataFrame, bins, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A histogram over given bins of all that has arrived, handed over whole after every micro-batch."""
    at = bins.index(F.when(~F.coalesce("flagged", F.lit(False)), F.col("value")))
    counts = stream.select(at.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def growing_snapshots(stream: DataFrame, bin_count: int, sink: Callable[[Provisional, int], None], checkpoint: str, provisional: int = 0):
    """The one-pass histogram of all that has arrived, over its own range and with all totals, after every micro-batch.

    What is kept is one state of a fixed number of bins.  It is written beside the stream's checkpoint before it
    is handed over, one file a batch, so that a stream that starts again goes on from the last batch that counted.
    """
    size = provisional_bins(bin_count, provisional)
    folder = Path(checkpoint.removeprefix("file://")) / "histogram"
    folder.mkdir(parents=True, exist_ok=True)

    def each(batch: DataFrame, number: int) -> None:
        v = good(F.col("value"), F.col("flagged"))
        states = provisional_states(batch.select(F.when(v.isNotNull(), F.col("value").cast("float")).alias("value")), size).collect()
        before = folder / f"{number - 1}"
        total = pickle.loads(before.read_bytes()) if before.exists() else Provisional(size)
        for s in states:
            total.merge(pickle.loads(s["state"]))
        part = folder / f".{number}"
        part.write_bytes(pickle.dumps(total))
        part.replace(folder / f"{number}")
        sink(total, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
