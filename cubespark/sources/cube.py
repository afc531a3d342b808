"""The pixel relation of a Zarr image as a Python data source: format ``cube``.

Options: ``path``; ``image`` (the default image if missing); ``mask`` (false: flags are not read);
``channels``, ``polarizations``, ``times``, ``x``, ``y`` as start:count:stride; ``chunks`` as "cx,cy;..."
of the spatial chunks to read; ``budgetBytes`` that a task's chunks may hold (see ``read_budget``), or
``threads`` that decode and ``tasks`` there should be at least (the session's cores, by ``load``).

Selections are options, and not pushed filters, because one loaded source may stand in a plan more than
once with different filters.  A scan reads only the chunks that its selection touches; chunks are numbers
that tasks turn into boxes, so that the driver lists none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CubeError
from ..model import CubeMeta, Range
from ..session import reachable
from .images import ROLE_OF, Image, open_dataset

SCHEMA = "time int, polarization int, channel int, y int, x int, value float, flagged boolean"
ARROW = pa.schema([*[(n, pa.int32()) for n in ("time", "polarization", "channel", "y", "x")], ("value", pa.float32()), ("flagged", pa.bool_())])
OPTION = {"spectral": "channels", "polarization": "polarizations", "time": "times", "x": "x", "y": "y"}
ROWS = 1 << 18
#: How often a chunk is held while it is read, bounds of the default read budget, and the most tasks of a scan.
HELD, LEAST, MOST, MOST_TASKS = 3, 256 << 20, 2 << 30, 100_000


def parse_range(text: str, length: int, name: str) -> Range:
    try:
        parts = [int(x) for x in text.split(":")]
        found = Range(parts[0], parts[1] if len(parts) > 1 else 1, parts[2] if len(parts) > 2 else 1)
    except (ValueError, IndexError):
        raise CubeError("invalid_slice", f"{name}: {text!r} is not start:count:stride") from None
    return found.checked(length, name)


def ranges_of(options: dict, cube: CubeMeta) -> dict[str, Range]:
    given = {k.lower(): v for k, v in options.items()}
    return {a.role: parse_range(given[OPTION[a.role].lower()], a.length, a.name) if OPTION[a.role].lower() in given else Range(0, a.length) for a in cube.axes}


def read_budget(chunk_bytes: int, threads: int = 1) -> int:
    """Bytes that a read may hold by default: two chunks for each thread that decodes, within 256 MiB and 2 GiB; a chunk is held three times (packed, decoded, as rows)."""
    return min(MOST, max(LEAST, HELD * max(1, chunk_bytes) * 2 * max(1, threads)))


@dataclass(frozen=True)
class Span:
    """The chunks of one axis that a range touches, by number."""

    range: Range
    size: int

    @property
    def count(self) -> int:
        r = self.range
        return r.count if r.stride > self.size else r.last // self.size - r.start // self.size + 1

    def chunk(self, k: int) -> int:
        r = self.range
        return (r.start + k * r.stride) // self.size if r.stride > self.size else r.start // self.size + k


@dataclass
class Chunks(InputPartition):
    """The stored chunks that one task reads, by their numbers in the scan: first up to last, exclusive."""

    first: int
    last: int


@dataclass(frozen=True)
class Scan:
    """The stored chunks that a selection touches, numbered in stored order (with cells: the cells fastest), never listed.

    spans: of each stored axis, x and y among them only if cells is None; cells: the spatial chunks to read.
    """

    roles: tuple[str, ...]
    spans: dict[str, Span]
    cells: tuple[tuple[int, int], ...] | None
    chunk_bytes: int

    @property
    def free(self) -> list[str]:
        return [r for r in self.roles if self.cells is None or r not in ("x", "y")]

    @property
    def count(self) -> int:
        n = 1 if self.cells is None else len(self.cells)
        for r in self.free:
            n *= self.spans[r].count
        return n

    def place(self, number: int) -> dict[str, int]:
        """Chunk indices by role."""
        out = {}
        if self.cells is not None:
            number, k = divmod(number, len(self.cells))
            out["x"], out["y"] = self.cells[k]
        for r in reversed(self.free):
            number, k = divmod(number, self.spans[r].count)
            out[r] = self.spans[r].chunk(k)
        return out

    def box(self, number: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """A chunk's part of the selection in stored order, ends exclusive."""
        at = self.place(number)
        low = tuple(max(at[r] * self.spans[r].size, self.spans[r].range.start) for r in self.roles)
        high = tuple(min((at[r] + 1) * self.spans[r].size, self.spans[r].range.last + 1) for r in self.roles)
        return low, high

    def partitions(self, budget: int | None = None, threads: int = 1, least: int = 1) -> list[Chunks]:
        """Runs of chunks for tasks: as many as the budget holds, fewer if that leaves less than ``least`` tasks, more if it leaves over ``MOST_TASKS``."""
        held = HELD * self.chunk_bytes
        each = max(1, (read_budget(self.chunk_bytes, threads) if budget is None else budget) // held)
        if budget is None:
            each = min(each, max(1, self.count // max(1, least)))
        each = max(each, -(-self.count // MOST_TASKS))
        return [Chunks(a, min(a + each, self.count)) for a in range(0, self.count, each)]


def plan_scan(image: Image, ranges: dict[str, Range], cells: set[tuple[int, int]] | None = None) -> Scan:
    """The scan of a selection; cells outside it are left out."""
    a = image.array
    roles = tuple(ROLE_OF[d] for d in a.dims)
    spans = {role: Span(ranges[role], n) for role, n in zip(roles, a.stored)}
    if cells is not None:
        inside = [{spans[r].chunk(k) for k in range(spans[r].count)} for r in ("x", "y")]
        cells = tuple(sorted(c for c in cells if c[0] in inside[0] and c[1] in inside[1]))
    return Scan(roles, spans, cells, decoded_chunk_bytes(image))


class CubeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise CubeError("invalid_argument", "a cube needs a path")
        dataset = open_dataset(self.path)
        name = options.get("image") or dataset.default_image()
        image = dataset.image(name)
        self.name, self.ranges = name, ranges_of(options, image.cube)
        self.flag = image.flag if str(options.get("mask", "true")).lower() == "true" else None
        cells = options.get("chunks")
        cells = {tuple(map(int, c.split(","))) for c in cells.split(";") if c} if cells is not None else None
        self.scan = plan_scan(image, self.ranges, cells)
        given = {k.lower(): int(v) for k, v in options.items() if k.lower() in ("budgetbytes", "threads", "tasks")}
        self.tasks = given.get("budgetbytes"), given.get("threads", 1), given.get("tasks", 1)

    def partitions(self):
        return self.scan.partitions(*self.tasks) or [Chunks(0, 0)]

    def read(self, partition: Chunks):
        from .zarr import Store

        store = Store(self.path)
        a = store.verified(self.name)
        roles = self.scan.roles
        flags = store.verified(self.flag) if self.flag else None
        for low, high in map(self.scan.box, range(partition.first, partition.last)):
            values = store.box(self.name, a, low, high).astype(np.float32)
            flagged = store.box(self.flag, flags, low, high) if flags else np.zeros(values.shape, bool)
            picks, indices = [], {}
            for role, begin, end in zip(roles, low, high):
                r = self.ranges[role]
                here = np.arange(begin, end)
                keep = (here - r.start) % r.stride == 0
                picks.append(np.flatnonzero(keep))
                indices[role] = here[keep].astype(np.int32)
            shape = tuple(map(len, picks))
            n = int(np.prod(shape))
            if not n:
                continue
            values, flagged = values[np.ix_(*picks)].ravel(), flagged[np.ix_(*picks)].ravel()
            places = {role: np.broadcast_to(indices[role].reshape([-1 if i == k else 1 for i in range(len(shape))]), shape).ravel() for k, role in enumerate(roles)}
            columns = [places["time"], places["polarization"], places["spectral"], places["y"], places["x"], values, flagged]
            for at in range(0, n, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + ROWS])) for c in columns], schema=ARROW)


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CubeReader:
        return CubeReader(dict(self.options))


def load(spark: SparkSession, path: str, image: str | None = None, **options) -> DataFrame:
    """The pixels of an image; each call is a scan of its own."""
    reachable(spark).dataSource.register(CubeSource)
    if image:
        options["image"] = image
    options.setdefault("tasks", spark.sparkContext.defaultParallelism)
    return spark.read.format("cube").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def options_of(ranges: dict[str, Range]) -> dict[str, str]:
    """The load options of a selection."""
    return {OPTION[role]: f"{r.start}:{r.count}:{r.stride}" for role, r in ranges.items() if role in OPTION}


def reader(spark: SparkSession, path: str, image: str | None = None, **options) -> Callable[[dict[str, Range]], DataFrame]:
    """What loads the pixels of a selection: each call is a scan of that selection's chunks alone."""
    return lambda ranges: load(spark, path, image, **options, **options_of(ranges))


def decoded_chunk_bytes(image: Image, flag: bool = True) -> int:
    """What one stored chunk takes decoded, its flags included."""
    n = int(np.prod(image.array.stored))
    return 4 * n + (n if flag and image.flag else 0)
