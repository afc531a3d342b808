"""Repeated passages by difference-cover anchors.

A window is ``window`` consecutive words of one text.  Every word that lies in
a window whose word sequence also starts anywhere else is repeated.

Hashing every window would move one hash a word.  Instead, with a difference
cover D modulo ``period``, only runs of ``window - period + 1`` words that start
at positions in D (modulo the period, counted from the text's start) are hashed:
for any two places i and j there is a shift l below the period with i + l and
j + l both in D, so two equal windows share an anchor.  Texts are packed in
blocks (compressed, many rows each), and

1. each block sends its distinct anchor hashes out by hash; an anchor that
   another block, or another place of the same block, holds comes back marked;
2. windows that contain a marked anchor are candidates: their hashes (96 bits)
   go out in the same way, and those met again are the repeated windows - the
   extension of an anchor to the whole match (two windows are taken for the same if
   these hashes are; none is compared word by word);
3. words under repeated windows are cut.

A block sends each hash once, however often it holds it, so that a passage that
a third of all texts share is one row a block.  Texts without candidates are
done after step 1 and are not moved again.

Null texts have no words; texts shorter than a window keep all words; null and
repeated doc_ids each keep their row (and equal rows repeat each other); empty
tables give empty tables; extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import Block, as_rows, blocks_of, renamed, slices_of, stored, word_spans

#: Difference covers by period: every residue is a difference of two members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bytes of text in a block: about forty times as much is held while its words are hashed.
BLOCK = 4 << 20
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("open", pa.bool_()), ("payload", pa.binary())])
BLOCKS_DDL = "block bigint, bucket int, open boolean, payload binary"


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover whose anchors still have a third of the window's words."""
    return max((p, d) for p, d in COVERS.items() if p == 7 or window - p + 1 >= window // 3)


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _row(block: int, bucket: int, payload: bytes, is_open: bool = False) -> pa.RecordBatch:
    return as_rows(BLOCKS, block=[block], bucket=[bucket], open=[is_open], payload=[payload])


def _packed(block: Block, kept: pa.RecordBatch, starts: bytes = b"") -> bytes:
    """A block of texts with the other columns of its rows; starts: a bit for each word, set where a candidate window starts."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as out:
        out.write_batch(kept)
    return pickle.dumps((_squeeze(block.data.tobytes()), block.offsets, _squeeze(sink.getvalue().to_pybytes()), starts))


def _unpacked(payload: bytes) -> tuple[Block, pa.Table, bytes]:
    data, offsets, kept, starts = pickle.loads(payload)
    return Block(0, np.frombuffer(_expand(data), np.uint8), offsets), pa.ipc.open_stream(_expand(kept)).read_all(), starts


def _pack(batches):
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for block in blocks_of(batch.column(0), BLOCK):
            number += 1
            kept = batch.select(batch.schema.names[1:]).slice(block.first, block.rows)
            yield _row(number, -1, _packed(block, kept))


class Words:
    """The words of a block: codes, hashes and places."""

    def __init__(self, block: Block):
        self.block = block
        self.starts, self.ends, self.counts = word_spans(block)
        coded = slices_of(block.data, self.starts, self.ends).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        self.hashes = [np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))[codes] for seed in (11, 23)]
        self.first = np.cumsum(self.counts) - self.counts
        self.inside = np.arange(len(codes)) - np.repeat(self.first, self.counts)  # position in the text
        self.room = np.repeat(self.counts, self.counts) - self.inside  # words from here to the text's end

    def rolling(self, size: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the runs of ``size`` words that start at the given words."""
        h = self.hashes[which]
        n = len(h)
        base = np.uint64(BASES[which])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:n], dtype=np.uint64)])
            x = (total[at + size] - total[at]) * back[at]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ x >> np.uint64(29)

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
        member = np.isin(np.arange(period), cover)
        return np.flatnonzero(member[self.inside % period] & (self.room >= window - period + 1))

    def candidates(self, marked: np.ndarray, window: int, period: int) -> np.ndarray:
        """Window starts at most period - 1 words before a marked anchor that contain all of it."""
        n = len(self.inside)
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, marked - np.minimum(self.inside[marked], period - 1), 1)
        np.add.at(change, marked + 1, -1)
        return np.flatnonzero((np.cumsum(change[:n]) > 0) & (self.room >= window))

    def covered(self, starts: np.ndarray, window: int) -> np.ndarray:
        n = len(self.inside)
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        return np.cumsum(change[:n]) > 0


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of each key among them, counts); pairs are sorted as two columns, much sooner than as records."""
    if keys.dtype.names is None:
        return np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((keys["k1"], keys["k0"]))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k["k0"][1:] != k["k0"][:-1]) | (k["k1"][1:] != k["k1"][:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return k[at], place, np.diff(np.append(at, len(k)))


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some."""
    if keys.dtype.names is None:
        return np.isin(keys, some)
    distinct, place, _ = _grouped(np.concatenate([some, keys]))
    known = np.zeros(len(distinct), bool)
    known[place[: len(some)]] = True
    return known[place[len(some) :]]


def _dealt(block: int, hashes: np.ndarray, buckets: int):
    """One row for each bucket: the block's distinct hashes there, and which of them it holds twice."""
    distinct, _, counts = _grouped(hashes)
    bucket = ((distinct["k0"] if distinct.dtype.names else distinct) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    kind = distinct.dtype.descr if distinct.dtype.names else "<u8"
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        mine = order[bounds[b] : bounds[b + 1]]
        yield _row(block, b, pickle.dumps((distinct[mine].tobytes(), np.packbits(counts[mine] > 1).tobytes(), kind)))


def _anchor_rows(batches, window: int, buckets: int):
    period, cover = cover_of(window)
    for batch in batches:
        for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            words = Words(_unpacked(payload)[0])
            at = words.anchors(window, period, cover)
            yield from _dealt(number, words.rolling(window - period + 1, at), buckets)


def _met_again(table: pa.Table) -> pa.Table:
    """One bucket of hashes: to each block the ones that it holds twice or another block holds too."""
    found = []
    for payload in table.column("payload").to_pylist():
        raw, twice, kind = pickle.loads(payload)
        keys = np.frombuffer(raw, np.dtype(kind))
        found.append((keys, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(keys)).astype(bool)))
    _, place, counts = _grouped(np.concatenate([k for k, _ in found]))
    again = counts > 1
    out, low = [], 0
    for keys, twice in found:
        hit = again[place[low : low + len(keys)]] | twice
        low += len(keys)
        out.append(keys[hit].tobytes())
    some = [i for i, x in enumerate(out) if x]
    return pa.table({"block": table.column("block").take(pa.array(some, pa.int64())), "bucket": pa.array([0] * len(some), pa.int32()), "open": pa.array([False] * len(some)), "payload": pa.array([out[i] for i in some], pa.binary())}, schema=BLOCKS)


def _gathered(table: pa.Table) -> tuple[int, bytes | None, bytes]:
    """(block, its packed texts, all hashes sent back to it)."""
    own, back = None, []
    for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
        if bucket < 0:
            own = payload
        else:
            back.append(payload)
    return table.column("block")[0].as_py(), own, b"".join(back)


def _take(block: Block, kept: pa.Table, rows: np.ndarray, starts: bytes = b"") -> bytes:
    lengths = np.diff(block.offsets)[rows]
    raw = memoryview(block.data)
    data = b"".join(raw[block.offsets[r] : block.offsets[r + 1]] for r in rows.tolist())
    part = Block(0, np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
    batch = kept.take(pa.array(rows)).combine_chunks().to_batches()
    return _packed(part, batch[0] if batch else pa.RecordBatch.from_pylist([], kept.schema), starts)


def _extend(table: pa.Table, window: int) -> pa.Table:
    """A block and its marked anchors: texts without candidates, and the others with their candidates."""
    number, own, back = _gathered(table)
    block, kept, _ = _unpacked(own)
    period, cover = cover_of(window)
    if not back:
        return pa.Table.from_batches([_row(number, -1, own)])
    words = Words(block)
    at = words.anchors(window, period, cover)
    marked = at[_among(words.rolling(window - period + 1, at), np.frombuffer(back, np.uint64))]
    starts = np.zeros(len(words.starts), bool)
    starts[words.candidates(marked, window, period)] = True
    row_of = np.repeat(np.arange(block.rows), words.counts)
    busy = np.zeros(block.rows, bool)
    busy[row_of[starts]] = True
    out = []
    if not busy.all():
        out.append(_row(number, -1, _take(block, kept, np.flatnonzero(~busy))))
    if busy.any():
        out.append(_row(number, -1, _take(block, kept, np.flatnonzero(busy), np.packbits(starts[busy[row_of]]).tobytes()), True))
    return pa.Table.from_batches(out)


#: 96 bits of a window.
WINDOW = np.dtype([("k0", "<u8"), ("k1", "<u4")])


def _window_hashes(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    out = np.empty(len(starts), WINDOW)
    out["k0"] = words.rolling(window, starts)
    out["k1"] = words.rolling(window, starts, 1) >> np.uint64(32)
    return out


def _candidates(starts: bytes, words: Words) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), count=len(words.starts)))


def _window_rows(batches, window: int, buckets: int):
    for batch in batches:
        for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            block, _, starts = _unpacked(payload)
            words = Words(block)
            yield from _dealt(number, _window_hashes(words, _candidates(starts, words), window), buckets)


def _finish(payload: bytes, back: bytes, window: int, schema: pa.Schema, whole: bool = False):
    block, kept, starts = _unpacked(payload)
    if back:
        words = Words(block)
        at = _candidates(starts, words)
        gone = words.covered(at[_among(_window_hashes(words, at, window), np.frombuffer(back, WINDOW))], window)
        first, last, counts = words.starts, words.ends, words.counts
    else:
        first, last, counts = word_spans(block)
        gone = np.zeros(len(first), bool)
    stay = ~gone
    left = slices_of(block.data, first[stay], last[stay])
    row_of = np.repeat(np.arange(block.rows), counts)
    sizes = np.bincount(row_of[stay], minlength=block.rows)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), left.cast(pa.string()))
    columns = {"kept": pc.binary_join(lists, " "), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(counts - sizes, pa.int64())}
    if whole:
        texts = pa.LargeStringArray.from_buffers(block.rows, pa.py_buffer(block.offsets.astype(np.int64)), pa.py_buffer(block.data))
        columns["kept"] = pc.if_else(pc.equal(columns["n_removed"], 0), texts.cast(pa.string()), columns["kept"])
    out = [columns[n] if i < 3 else kept.column(i - 3) for i, n in enumerate(schema.names)]
    return pa.Table.from_arrays(out, schema=schema)


def _finish_closed(batches, window: int, schema: pa.Schema, whole: bool = False):
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            yield from _finish(payload, b"", window, schema, whole).combine_chunks().to_batches()


def _finish_open(table: pa.Table, window: int, schema: pa.Schema, whole: bool = False) -> pa.Table:
    _, own, back = _gathered(table)
    return _finish(own, back, window, schema, whole)


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, keep: tuple[str, ...] = (), buckets: int | None = None, whole: bool = False) -> DataFrame:
    """(kept string, n_words, n_removed, doc_id, *keep): each text's words that no repeated window covers, joined by one space.

    buckets: into how many parts hashes are dealt out; by default the shuffle partitions, or more
    so that a part has about 2 million words' anchors.
    whole: texts that nothing is removed from are kept as they are, not as joined words (null as empty).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    source = renamed(docs, text, doc_id, *keep)
    source = source.withColumn(text, F.col(text).cast("string"))
    kept_fields = [StructField(f.name, f.dataType) for f in source.schema.fields[1:]]
    result = StructType([StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), *kept_fields])
    schema = to_arrow_schema(result)
    packed = stored(source.mapInArrow(_pack, BLOCKS_DDL), "substring-blocks")
    packed_bytes = packed.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(least, -(-packed_bytes // (8 << 20)))
    tasks = max(least, -(-packed_bytes // (16 << 20)))  # their number follows the input, not the session's setting alone
    anchors = packed.mapInArrow(functools.partial(_anchor_rows, window=window, buckets=buckets), BLOCKS_DDL)
    marks = anchors.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_met_again, BLOCKS_DDL)
    split = stored(packed.unionByName(marks).repartition(tasks, "block").groupBy("block").applyInArrow(lambda table: _extend(table, window), BLOCKS_DDL), "substring-candidates")
    again = split.filter("open").mapInArrow(functools.partial(_window_rows, window=window, buckets=buckets), BLOCKS_DDL).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_met_again, BLOCKS_DDL)
    busy = split.filter("open").unionByName(again).repartition(tasks, "block").groupBy("block").applyInArrow(lambda table: _finish_open(table, window, schema, whole), result)
    return split.filter("not open").mapInArrow(functools.partial(_finish_closed, window=window, schema=schema, whole=whole), result).unionByName(busy)
