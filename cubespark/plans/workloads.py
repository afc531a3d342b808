"""The six ways in which a cube is read, as timed trials whose rows are benchmark results (B1)."""

from __future__ import annotations

import time
import zlib
from dataclasses import replace
from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import CubeError
from ..model import CubeMeta, PlaneSelection, Range, Region
from ..operators import histogram, layouts, positions, reduce, regions, selection
from ..sources import cube as cubes
from ..sources import images
from ..sources.results import SCHEMA

FIELDS = [f.split() for f in SCHEMA.replace("\n", " ").split(",")]


def _read(spark: SparkSession, path: str, name: str, cube: CubeMeta, op: positions.Operation) -> np.ndarray:
    """The pixels of an operation's box in logical order, flagged ones NaN."""
    options = {"channels": f"{op.channel}:{op.channels}", "polarizations": f"{op.polarization}:1", "x": f"{op.x}:{op.width}", "y": f"{op.y}:{op.height}"}
    read = selection.hyperslab(cubes.load(spark, path, name, **options), cube, op.ranges(cube))
    table = read.select("polarization", "channel", "y", "x", "value").toArrow()
    order = np.lexsort([table.column(c).to_numpy() for c in ("x", "y", "channel", "polarization")])
    return table.column("value").to_numpy()[order]


def _sum(values: np.ndarray) -> str:
    """A checksum that every NaN enters alike."""
    return f"{zlib.crc32(np.where(np.isnan(values), np.float32(np.nan), values.astype(np.float32)).tobytes()):08x}"


def _region(spark: SparkSession, path: str, name: str, cube: CubeMeta, op: positions.Operation) -> np.ndarray:
    box = Region(0, op.x, op.y, op.width, op.height)
    frame = regions.region_table(spark, [box], cube)
    pixels = cubes.load(spark, path, name, x=f"{op.x}:{op.width}", y=f"{op.y}:{op.height}", polarizations=f"{op.polarization}:1")
    found = reduce.spectral_reduce(pixels, cube, regions.runs_of(frame), frame.select("region_id"), PlaneSelection(Range(0, cube.length("spectral")), op.polarization), most_runs=regions.most_runs([box]))
    block = reduce.Block.of(found)
    return np.concatenate([block.values[0, n] for n in ("num_pixels", "nan_count", "min", "max")])


def _histogram(spark: SparkSession, path: str, name: str, cube: CubeMeta, op: positions.Operation, settings: positions.Settings) -> np.ndarray:
    pixels = cubes.load(spark, path, name, channels=f"{op.channel}:{op.channels}", polarizations=f"{op.polarization}:1")
    planes, bins = PlaneSelection(Range(op.channel, op.channels), op.polarization), histogram.auto_bins(cube.length("x"), cube.length("y"))
    found = histogram.cube_histogram_exact(pixels, cube, bins, planes)[1] if settings.method == "exact" else histogram.cube_histogram_onepass(pixels, cube, bins, planes, every=settings.stride)
    return found.select("count").toArrow().column(0).to_numpy()


def _frames(spark: SparkSession, path: str, name: str, cube: CubeMeta, op: positions.Operation) -> tuple[np.ndarray, list[float]]:
    took, values = [], []
    for c in range(op.channel, op.channel + op.channels):
        began = time.perf_counter()
        values.append(_read(spark, path, name, cube, replace(op, channel=c, channels=1)))
        took.append(time.perf_counter() - began)
    return np.concatenate(values), took


def trial(spark: SparkSession, path: str, mode: str, image: str | None = None, seed: int = 1, number: int = 0, processes: int = 1, ops: int | None = None, settings: positions.Settings = positions.Settings(), fps: float = 5.0, label: str = "") -> DataFrame:
    """Runs the planned operations of one trial one after the other; a row for each, of the columns of results.SCHEMA.

    Operations that fail are rows with the refusal's code.  first-touch marks are those of the planned chunks; an
    animation, which plays neighbouring planes on purpose, has frame times instead.
    """
    dataset = images.open_dataset(path)
    name = image or dataset.default_image()
    cube = dataset.image(name).cube
    planned = positions.plan(mode, cube, seed, number, processes, ops, settings)
    shared = {}
    if mode in ("plane", "spectrum", "region") and planned:
        shared = {(r.process, r.op): r.shares_chunks for r in layouts.shared_chunks(positions.operations(spark, planned, cube)).collect()}  # a row an operation
    rows, start = [], time.perf_counter()
    for op in planned:
        began, row, took = time.perf_counter(), {"status": "ok"}, None
        try:
            if mode == "open":
                found = np.array([images.open_dataset(path).image(name).cube.length(r) for r in ("x", "y", "spectral")], np.float32)
            elif mode == "region":
                found = _region(spark, path, name, cube, op)
            elif mode == "cube_histogram":
                found = _histogram(spark, path, name, cube, op, settings)
            elif mode == "animation":
                found, took = _frames(spark, path, name, cube, op)
            else:
                found = _read(spark, path, name, cube, op)
            row |= {"checksum": _sum(found.astype(np.float32)), "elements": 0 if mode == "open" else op.width * op.height * op.channels}
        except CubeError as e:
            row |= {"status": "error", "error": e.code}
        ended = time.perf_counter()
        if took:
            later = sorted(took[1:])
            late = [t - 1 / fps for t in later if t > 1 / fps]
            row |= {"frames_played": len(took), "frame_first_s": took[0], "frame_median_s": later[len(later) // 2] if later else None, "frame_max_s": later[-1] if later else None, "late_frames": len(late), "late_max_s": max(late, default=0.0)}
        box = f"pol={op.polarization};chan={op.channel}:{op.channel + op.channels};l={op.x}:{op.x + op.width};m={op.y}:{op.y + op.height}"
        row |= {"run_key": f"{label}/{mode}", "label": label, "dataset": path, "image_id": name, "mode": mode, "method": settings.method if mode == "cube_histogram" else "", "users": processes, "seed": seed, "ops": len(planned) // processes, "trial": number, "process_index": op.process, "op_index": op.op, "position": box}
        row |= {"overlap": op.overlap, "shares_chunks": shared.get((op.process, op.op)), "seconds": ended - began, "t_start_s": began - start, "t_end_s": ended - start, "logical_bytes": 4 * row.get("elements", 0), "attempt": 0}
        rows.append(tuple(row.get(n) for n, _ in FIELDS))
    return spark.createDataFrame(rows, SCHEMA)


def trials(spark: SparkSession, path: str, modes: dict[str, int], **how) -> DataFrame:
    """One trial of each mode with so many operations."""
    return fold(DataFrame.unionByName, [trial(spark, path, mode, ops=n, **how) for mode, n in modes.items()])
