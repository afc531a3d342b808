"""Media columns: texts as 8-bit samples of lossless WebP images, written to the shared folder and read back.

Null texts count as empty; an empty text has 64 zero samples; equal texts give
equal files and features; repeated rows repeat, and rows without a doc_id stay; empty
tables give empty tables; extra columns stay out, whatever their names.  Texts are
encoded and decoded some at a time by their bytes, so that memory follows one block or
one long text; a text over 2**28 bytes, the format's largest image, raises.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .blocks import as_rows, renamed, stored

MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("media", pa.binary())])
PIXELS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
#: Rows and bytes that are encoded or decoded at a time (one longer text is a part by itself).
ROWS, PART = 128, 2 << 20


def _parts(sizes: np.ndarray):
    """(first, number) of runs of rows of at most ROWS rows and, but for single rows, PART bytes."""
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        n = min(max(1, int(np.searchsorted(ends, before + PART, side="right")) - lo), ROWS)
        yield lo, n
        lo += n


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _written(batches):
    for batch in batches:
        for lo, n in _parts(_sizes(batch.column(1))):
            part = batch.slice(lo, n)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            padded = [t.ljust(max(1, -(-len(t) // 64)) * 64, b"\0") for t in texts]
            yield as_rows(MEDIA, doc_id=part.column(0), n_bytes=list(map(len, texts)), payload_bytes=list(map(len, padded)), media=list(map(webp.encode_samples, padded)))


def write_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): a WebP file of every text, padded with bytes 0 to a positive multiple of 64."""
    source = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return stored(source.mapInArrow(_written, "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary"), "media")


def feature_of(samples: bytes) -> str:
    """64 bits: whether each 64th of the samples is lighter than the mean of all."""
    cells = np.frombuffer(samples, np.uint8).reshape(64, -1).sum(axis=1, dtype=np.int64)
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()


def _read(batches):
    for batch in batches:
        for lo, n in _parts(batch.column(2).to_numpy()):
            part = batch.slice(lo, n)
            files, sizes = part.column(3).to_pylist(), part.column(2).to_pylist()
            shapes = list(map(webp.size_of, files))
            samples = [webp.samples(f)[:k] for f, k in zip(files, sizes)]
            yield as_rows(PIXELS, doc_id=part.column(0), n_bytes=part.column(1), payload_bytes=list(map(len, samples)), media_bytes=list(map(len, files)), media_sha256=[hashlib.sha256(f).hexdigest() for f in files], width=[w for w, _ in shapes], height=[h for _, h in shapes], samples=samples, tail_crc32=[zlib.crc32(s[-64:]) for s in samples], feature=list(map(feature_of, samples)))


def read_media(media: DataFrame) -> DataFrame:
    """The files decoded: width, height, the array of samples, and what is computed from them."""
    return media.mapInArrow(_read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, media_bytes bigint, media_sha256 string, width int, height int, samples binary, tail_crc32 bigint, feature string")
