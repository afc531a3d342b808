"""Best-fit packing of token pieces under several capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum
of the squares of its pieces' lengths).  Pieces are placed longest first, each
into the sequence that fits best among all that can take it under every
constraint: least weighted norm of what is left (``rule="norm"``) or greatest
weighted dot product of the piece and what is left (``rule="dot"``).

A piece's vector follows from its length alone, so pieces of one length are
alike, and so are sequences with equal residuals.  The planner therefore works
on *counts*: it sees one row for each length (at most ``max_tokens`` rows,
whatever the input) and writes a plan of runs: "of the pieces of this length,
those ranked a to b go k each into sequences from s on, at this offset".
Pieces get their rank within a length without sorting: a rank in their own
part of the table plus the number of such pieces in the parts before.  All
pieces follow the plan in parallel; it is what placing them one by one gives.

Documents: a null text counts as empty and is a piece of its end token alone;
null and repeated doc_ids each keep their own pieces; an empty table packs to
an empty table; other columns are left out.  Very long texts are cut into as many
pieces as they need.  Of groups of sequences that fit equally well the one that stands
first is taken, and of pieces of one length the order of parts and places decides, so
that a run that is repeated over the same parts gives the same sequences.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import as_rows, blocks_of, renamed, stored
from .pretokens import WordIds

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])
PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, place bigint"

#: Bytes of text that are cut at a time: each distinct word is looked up once in them.
BLOCK = 6 << 20


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold; None: no limit of that kind beyond what max_tokens implies."""

    max_tokens: int = 1024
    max_docs: int | None = None
    max_attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.max_tokens, self.max_docs or self.max_tokens, self.max_attention or self.max_tokens**2], np.int64)


@dataclass
class Plan:
    """Runs: pieces of ``length`` ranked from ``rank`` on go ``each`` into sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_best_fit(counts: dict[int, int], capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm") -> Plan:
    """Places counts[length] pieces of each length, longest first.

    Sequences with equal residuals are one group with a range of numbers; a step takes the best
    group and fills as many of its sequences as it can, each as far as it goes.  Filling the same
    sequence on is what best fit does: its residual has only become smaller.
    """
    full = capacity.vector()
    scale, w = full.astype(float), np.array(weights)
    left = np.zeros((0, 3), np.int64)  # residuals of groups that are open
    low = np.zeros(0, np.int64)
    size = np.zeros(0, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0
    least = min(counts, default=0)
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence of {capacity}")
        rank, n = 0, counts[length]
        while n:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = (w * ((left[fits] - need) / scale) ** 2).sum(axis=1)
                elif rule == "dot":
                    score = -(w * (left[fits] / scale) * (need / scale)).sum(axis=1)
                else:
                    raise ValueError(f"unknown rule {rule!r}")
                g = int(fits[np.argmin(score)])
                room, first, bins = left[g].copy(), int(low[g]), int(size[g])
                keep = np.ones(len(left), bool)
                keep[g] = False
                left, low, size = left[keep], low[keep], size[keep]
            else:
                room, first = full, made
                bins = -(-n // int((full // need).min()))
                made += bins
            each = int((room // need).min())
            offset = int(full[0] - room[0])
            used, rest = divmod(n, each)
            used = min(used, bins)
            groups = [(room - each * need, first, used)]
            placed = used * each
            if used < bins and rest and placed + rest == n:
                groups += [(room - rest * need, first + used, 1), (room, first + used + 1, bins - used - 1)]
                placed += rest
            else:
                groups.append((room, first + used, bins - used))
            runs.append((length, rank, first, each, offset))
            rank, n = rank + placed, n - placed
            for r, a, m in groups:
                if m and r[0] >= least and r[1] > 0:
                    left, low, size = np.vstack([left, r]), np.append(low, a), np.append(size, m)
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=made)


def _cut(batches, path: str, end_id: int, max_tokens: int):
    words = WordIds(path)
    part, seen = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
    for batch in batches:
        doc_ids = batch.column(0)
        for block in blocks_of(batch.column(1), BLOCK):
            ids, counts = words.block_ids(block)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")  # an end token behind each document
            total = counts + 1
            begin = np.cumsum(total) - total
            pieces = -(-total // max_tokens)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = total - (pieces - 1) * max_tokens
            start = np.where(piece > 0, head[row] + (piece - 1) * max_tokens, 0)
            length = np.where(piece > 0, max_tokens, head[row])
            order = np.argsort(length, kind="stable")
            groups = length[order]
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.searchsorted(groups, groups) + seen[groups]
            seen += np.bincount(length, minlength=max_tokens + 1)
            raw, at = memoryview(ids.tobytes()), (begin[row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield as_rows(PIECES, doc_id=doc_ids.take(pa.array(row + block.first)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc, part=np.full(len(row), part), place=place)


def pieces_of(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, max_tokens: int = 1024) -> DataFrame:
    """Token pieces of at most max_tokens: whole documents with end_id behind them; of longer ones the first piece may be shorter."""
    source = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return source.mapInArrow(functools.partial(_cut, path=path, end_id=end_id, max_tokens=max_tokens), PIECES_DDL)


def _follow(batches, plan: Plan):
    schema = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
    key = plan.length << 40 | plan.rank
    for batch in batches:
        length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
        at = np.searchsorted(key, length << 40 | rank, side="right") - 1
        behind = rank - plan.rank[at]
        yield as_rows(schema, **{n: batch.column(n) for n in PIECES.names[:5]}, sequence_id=plan.sequence[at] + behind // plan.each[at], offset=plan.offset[at] + behind % plan.each[at] * length)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset there.

    The driver sees one count for each length.  By default only tokens bind, so that sequences are few.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, path, doc_id, text, end_id, capacity.max_tokens), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_best_fit(counts, capacity, weights, rule))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select(*PIECES.names[:5], (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(lambda batches: _follow(batches, plan.value), ", ".join([*PIECES_DDL.split(", ")[:5], "sequence_id bigint", "offset bigint"]))
