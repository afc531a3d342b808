"""A window of a data set in a new layout (S26): images chunk by chunk in tasks, small arrays on the driver."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import CubeError
from ..model import Range
from ..session import reachable
from . import codecs as cc
from .images import Dataset
from .writer import rounded_mantissa, write_array, write_group
from .zarr import Store


def rewrite(spark: SparkSession, source: str, target: str, image: str, chunk: dict[str, int], window: dict[str, Range] | None = None, codecs: list[dict] | None = None, mantissa: int | None = None) -> None:
    """Writes the image and its flag over the window (ranges of stride 1 by dimension) in new chunks, and all other arrays cropped where they share a dimension.

    Tasks write whole chunks, each its own file, so that a task that is run again writes the same.
    """
    dataset = Dataset(source)
    out = Path(target)
    if out.resolve() == dataset.store.root or out.exists():
        raise CubeError("invalid_argument", f"{target} is there already or is the input")
    main = dataset.store.verified(image)
    flag = dataset.flag_of(image, main)
    ranges = {d: (window or {}).get(d, Range(0, n)).checked(n, d) for d, n in zip(main.dims, main.shape)}
    if any(r.stride != 1 for r in ranges.values()):
        raise CubeError("invalid_slice", "a window has stride 1")
    for node in dataset.nodes.values():
        if node.array is None or node.name in (image, flag):
            continue
        a = node.array
        begin = tuple(ranges[d].start if d in ranges else 0 for d in a.dims or ("",) * len(a.shape))
        end = tuple(ranges[d].last + 1 if d in ranges else n for d, n in zip(a.dims or ("",) * len(a.shape), a.shape))
        values = dataset.store.labels(node.name)[begin[0] : end[0]] if a.type_name == "fixed_length_utf32" else dataset.store.box(node.name, a, begin, end)
        write_array(out / node.name, values, a.dims, tuple(min(c, max(1, e - b)) for c, b, e in zip(a.chunk, begin, end)), a.attributes)
    shape = tuple(ranges[d].count for d in main.dims)
    size = tuple(min(chunk.get(d, n), n) for d, n in zip(main.dims, shape))
    for name in filter(None, (image, flag)):
        a = dataset.store.array(name)
        # The document alone; chunks follow in tasks.
        write_array(out / name, np.broadcast_to(np.zeros((), cc.dtype_of(a.data_type)), shape), a.dims, size, a.attributes, codecs, "NaN" if a.fill == "NaN" else a.fill or 0, chunks=False)
    names, grid = [n for n in (image, flag) if n], tuple(-(-s // c) for s, c in zip(shape, size))
    each = int(np.prod(grid, dtype=object))
    low = tuple(ranges[d].start for d in main.dims)

    def written(batches):
        store, made = Store(source), Store(target)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                name, at = names[number // each], tuple(map(int, np.unravel_index(number % each, grid)))
                a, b = store.array(name), made.array(name)
                begin = tuple(x + i * c for x, i, c in zip(low, at, size))
                end = tuple(x + min((i + 1) * c, s) for x, i, c, s in zip(low, at, size, shape))
                part = store.box(name, a, begin, end)
                if mantissa is not None and part.dtype == np.float32:
                    part = rounded_mantissa(part, mantissa)
                whole = np.full(size, b.fill_value(part.dtype), part.dtype)
                whole[tuple(slice(0, n) for n in part.shape)] = part
                file = Path(target) / name / b.key(at)
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(cc.encode(whole, b.codecs))
            yield pa.RecordBatch.from_pydict({"done": [batch.num_rows]})

    write_group(out, dataset.store.attributes)
    # Chunks are numbered; a task has a range of numbers.
    jobs = len(names) * each
    reachable(spark).range(0, jobs, 1, max(1, min(jobs, max(4 * spark.sparkContext.defaultParallelism, jobs // 1024)))).mapInArrow(written, "done bigint").count()
