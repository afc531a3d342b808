"""Pixels as a Zarr image: chunk files are written by tasks, documents by the driver."""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..model import COLUMN, CubeMeta
from . import codecs as cc
from .writer import ZSTD, write_array

#: Dimension names by role, in stored order (fixed by the schema of sky images).
SKY = {"time": "time", "spectral": "frequency", "polarization": "polarization", "x": "l", "y": "m"}


def sharded(inner: tuple[int, ...], codecs: list[dict] | None = None) -> list[dict]:
    """A chain that gathers chunks of that shape in each file, with an index behind them."""
    index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
    return [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(inner), "codecs": codecs or ZSTD, "index_codecs": index, "index_location": "end"}}]


def write_image(pixels: DataFrame, folder: str, name: str, cube: CubeMeta, file_shape: dict[str, int], attributes: dict | None = None, codecs: list[dict] | None = None, column: str = "value", fill="NaN") -> None:
    """Writes a column of the pixel relation (float or boolean) as the array ``name`` of a store.

    A file's pixels are one group and one task's work, as large as the layout says; files in which every
    pixel has the fill value (or is missing) are not written.  A file appears whole or not at all, so a task
    that is run again changes nothing.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise CubeError("unsupported_transport", f"{folder} is no folder of a shared file system")
    target = Path(folder.removeprefix("file://")) / name
    roles = list(SKY)
    shape, size = tuple(cube.length(r) for r in roles), tuple(min(file_shape.get(r, cube.length(r)), cube.length(r)) for r in roles)
    kind = np.dtype(bool) if dict(pixels.dtypes)[column] == "boolean" else np.dtype(np.float32)
    fill = False if kind == bool else fill
    doc = write_array(target, np.broadcast_to(np.zeros((), kind), shape), tuple(SKY.values()), size, attributes, codecs, fill, chunks=False)
    empty = kind.type(np.nan if fill == "NaN" else fill)

    def written(table: pa.Table) -> pa.Table:
        at = tuple(table.column(f"c_{r}")[0].as_py() for r in roles)
        places = tuple(table.column(COLUMN[r]).to_numpy() - c * n for r, c, n in zip(roles, at, size))
        whole = np.full(size, empty, kind)
        whole[places] = table.column("v").fill_null(False if kind == bool else np.nan).to_numpy(zero_copy_only=False).astype(kind)
        if not ((whole == empty) | (whole != whole) & (empty != empty)).all():
            file = target / "/".join(["c", *map(str, at)])
            file.parent.mkdir(parents=True, exist_ok=True)
            part = file.with_name(f".{uuid.uuid4().hex}")
            part.write_bytes(cc.encode(whole, doc["codecs"]))
            part.rename(file)
        return pa.table({"done": pa.array([table.num_rows], pa.int64())})

    keys = [F.floor(F.col(COLUMN[r]) / n).cast("int").alias(f"c_{r}") for r, n in zip(roles, size)]
    keyed = pixels.select(*[COLUMN[r] for r in roles], F.col(column).alias("v"), *keys)
    keyed.groupBy(*[f"c_{r}" for r in roles]).applyInArrow(written, "done bigint").write.format("noop").mode("overwrite").save()
