"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive in Arrow batches.  A *block* is a run of whole rows whose UTF-8
bytes lie side by side in one buffer, so that numpy can look at all of them at
once.  Blocks end at row boundaries and hold about ``max_bytes`` bytes (one
longer text makes a block by itself): memory follows the block, not the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import shared_folder

BLOCK_BYTES = 2 << 20
#: Word separators of the contracts: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Block:
    """Rows [first, first + len(offsets) - 1) of a batch; row i holds data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> Iterator[bytes]:
        raw = self.data.tobytes()
        bounds = self.offsets.tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield raw[a:b]


def blocks_of(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, raw, content = column.buffers()
    bounds = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    everything = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, everything[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): byte spans of the words ``[^\\x20\\x09-\\x0D]+`` and how many each row has."""
    inside = ~SEPARATOR[block.data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = block.offsets[:-1]
    before[edges[edges < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = block.offsets[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, block.offsets))
    return starts, ends, counts


def slices_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of data[start:end]; spans are in order and do not overlap."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] = 1
    mark[ends] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start + length] of every pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def as_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in ((n, columns[n]) for n in schema.names)], schema=schema)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends there and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """As ``stored``, bucketed by a key: what is grouped by it later is read in place and not shuffled.

    Only a table keeps its buckets; its name is taken out of the catalog again once it is resolved, the files stay.
    """
    spark, name = df.sparkSession, f"{what.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.option("path", shared_folder(spark, what)).bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place: free of clashes with what an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def renamed(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns, taken once each even if the input has clashing extra columns of other cases.

    A wanted column that is missing raises, as any analysis error does.
    """
    names = df.columns
    chosen = []
    for name in wanted:
        if name not in names:
            raise ValueError(f"column {name!r} is missing; found {names}")
        chosen.append(names.index(name))
    unique = numbered(df)
    return unique.select(*[unique[f"c{i}"].alias(name) for i, name in zip(chosen, wanted)])
