"""BPE encoding and decoding by a table of distinct words.

``encode`` splits every text into pre-tokens inside Spark tasks, block by block.
A block keeps its texts as word numbers and its distinct words as one row for
each *bucket* of a hash of the word.  The bucket rows are dealt out by bucket,
so that every occurrence of a word in any block meets in one task, where the
word is encoded once; its ids go back to the blocks that asked, and a block's
word numbers pick them up by position.  What is shuffled is each block's
distinct words (never its occurrences) and its word numbers, compressed: no
word is hot, since a block asks for it once however often it holds it.

``decode`` joins ids to pieces: the table of pieces belongs to the tokenizer
file (fixed size, whatever the input), so it is read where it is needed.

Null texts count as empty and give no ids; empty tables give empty results;
repeated rows each give a row; null doc_ids are kept; other columns are left out.
Very long texts are encoded in full (one is a block by itself); special strings inside
texts are special tokens.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import as_rows, blocks_of, ragged, renamed, stored_by
from .pretokens import WordIds, byte_bpe, place_ids, split_block

PARTS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
PARTS_DDL = "block bigint, bucket int, doc_ids array<bigint>, counts array<bigint>, payload binary"


#: Words of a block are numbered by how often it holds them (these bounds, most first), then by
#: bucket, then in order: small numbers for frequent words and sorted words compress best.
OFTEN = (2, 4, 16, 64, 256)
BLOCK = 6 << 20


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Compressed arrays of 32-bit numbers, equal places of the numbers' bytes side by side."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(a) for a in arrays], "<u4").tobytes(), *planes]))


def _expand(payload: bytes, arrays: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    sizes, at, out = raw[: 4 * arrays].view("<u4").tolist(), 4 * arrays, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def _words_payload(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=9).compress(b"".join([np.array([len(words)], "<u4").tobytes(), sizes.tobytes(), *words]))


def _payload_words(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    bounds = [0, *np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()]
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip(bounds, bounds[1:])]


def _split(batches, path: str, buckets: int):
    number = TaskContext.get().partitionId() << 32
    special = tuple(byte_bpe(path).special)
    for batch in batches:
        doc_ids = batch.column(0)
        for block in blocks_of(batch.column(1), BLOCK):
            words, counts = split_block(block, special)
            distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
            bucket = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)) % buckets
            often = len(OFTEN) - np.searchsorted(OFTEN, np.bincount(codes, minlength=len(distinct)), side="right")
            rank = np.empty(len(distinct), np.int64)
            rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(distinct))
            place = np.empty(len(distinct), np.int64)
            place[np.lexsort((rank, bucket, often))] = np.arange(len(distinct))
            number += 1
            table = np.bincount(bucket.astype(np.int64) * (len(OFTEN) + 1) + often, minlength=buckets * (len(OFTEN) + 1))
            rows = [(-1, doc_ids.slice(block.first, block.rows).to_pylist(), counts, _squeeze(place[codes], table))]
            order = np.lexsort((rank, often, bucket))
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                rows.append((b, None, None, _words_payload([distinct[i] for i in order[bounds[b] : bounds[b + 1]].tolist()])))
            yield as_rows(PARTS, block=[number] * len(rows), bucket=[r[0] for r in rows], doc_ids=[r[1] for r in rows], counts=[r[2] for r in rows], payload=[r[3] for r in rows])


def _encode_words(batches, path: str):
    encoder = WordIds(path)
    for batch in batches:
        out = []
        for payload in batch.column("payload").to_pylist():
            ids, sizes = encoder.packed(_payload_words(payload))
            out.append(_squeeze(sizes, ids))
        n = batch.num_rows
        yield as_rows(PARTS, block=batch.column("block"), bucket=batch.column("bucket"), doc_ids=[None] * n, counts=[None] * n, payload=out)


def _assemble(own: pa.Table, words: pa.Table) -> pa.Table:
    """One block: its row of word numbers and, bucket by bucket, the ids of its words."""
    first, rest = own.to_pylist()[0], words.sort_by("bucket").to_pylist()
    codes, kinds = _expand(first["payload"], 2)
    parts = [_expand(row["payload"], 2) for row in rest]
    none = [np.zeros(0, "<u4")]
    sizes, ids = np.concatenate([p[0] for p in parts] or none).astype(np.int64), np.concatenate([p[1] for p in parts] or none)
    classes = len(OFTEN) + 1
    kind = np.repeat(np.arange(len(kinds)), kinds)
    if len(kind) != len(sizes):
        raise ValueError(f"a block asked for {len(kind)} words and got {len(sizes)}")
    order = np.lexsort((np.arange(len(kind)), kind // classes, kind % classes))
    flat, counts = place_ids(ids, sizes, order[codes], np.array(first["counts"], np.int64))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.table({"doc_id": pa.array(first["doc_ids"], pa.int64()), "ids": pa.ListArray.from_arrays(offsets, flat.astype(np.int32))})


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id bigint, ids array<int>) of every row; special strings in texts are special tokens, none are added.

    path: a byte-level BPE file of the tokenizers library.  buckets: into how many parts the
    distinct words fall, the shuffle partitions by default; a task holds one part's recent words.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    parts = stored_by(source.mapInArrow(functools.partial(_split, path=path, buckets=n), PARTS_DDL), "bpe-parts", "block", n)
    words = parts.filter("bucket >= 0").repartition(n, "bucket").mapInArrow(functools.partial(_encode_words, path=path), PARTS_DDL)
    return parts.filter("bucket < 0").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


def _pieces(batches, path: str, at: int, schema: pa.Schema):
    bpe = byte_bpe(path)
    sizes = np.fromiter(map(len, bpe.pieces), np.int64, bpe.size)
    flat, first = np.frombuffer(b"".join(bpe.pieces), np.uint8), np.cumsum(sizes) - sizes
    for batch in batches:
        column = batch.column(at)
        lists = column.to_pylist() if column.null_count else None
        for lo in range(0, batch.num_rows, 512):
            part = column.slice(lo, 512)
            if lists is not None:
                part = pa.array([x or [] for x in lists[lo : lo + 512]], pa.list_(pa.int32()))
            ids = part.flatten().to_numpy(zero_copy_only=False)
            known = (ids >= 0) & (ids < bpe.size)
            lengths = np.where(known, sizes[np.where(known, ids, 0)], 0)
            data = ragged(flat, first[np.where(known, ids, 0)], lengths)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            bounds = part.offsets.to_numpy() - part.offsets[0].as_py()
            offsets = ends[bounds].astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            try:
                texts = texts.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # ids may spell broken UTF-8
                texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
            rows = batch.slice(lo, 512)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns)), texts], schema=schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with a further column ``decoded`` (one of that name is replaced): the text that the ids spell, special tokens included.

    Ids outside the vocabulary spell nothing; broken UTF-8 turns into U+FFFD; null ids spell "".
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    encoded = encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    at = encoded.columns.index(ids)
    arrow = to_arrow_schema(schema)
    return encoded.mapInArrow(functools.partial(_pieces, path=path, at=at, schema=arrow), schema)
