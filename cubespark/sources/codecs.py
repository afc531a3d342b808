"""Chunk codecs of Zarr v3: bytes, transpose, gzip, zstd, blosc, crc32c, sharding."""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pyarrow as pa

from ..errors import CubeError

#: numpy kinds of the element types, little-endian (fixed values).
DTYPES = {
    "bool": "?", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4",
    "uint64": "<u8", "float16": "<f2", "float32": "<f4", "float64": "<f8", "complex64": "<c8", "complex128": "<c16",
}
REAL = tuple(n for n in DTYPES if n.startswith(("int", "uint", "float")))
COMPRESSORS = ("zstd", "gzip", "blosc")
MISSING = (1 << 64) - 1


def dtype_of(data_type) -> np.dtype:
    if isinstance(data_type, str) and data_type in DTYPES:
        return np.dtype(DTYPES[data_type])
    if isinstance(data_type, dict) and data_type.get("name") == "fixed_length_utf32":
        size = data_type.get("configuration", {}).get("length_bytes")
        if isinstance(size, int) and size > 0 and size % 4 == 0:
            return np.dtype(f"V{size}")
    raise CubeError("unsupported_data_type", f"data type {data_type!r}")


@functools.cache
def _crc_table() -> list[int]:
    """The reflected table of the Castagnoli polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


def _through(columns: np.ndarray, state: int) -> int:
    """A linear map of 32-bit words, given by what it makes of each bit, applied to one."""
    bits = state >> np.arange(32) & 1
    return int(np.bitwise_xor.reduce(np.where(bits, columns, 0)))


@functools.lru_cache(64)
def _past(n: int) -> np.ndarray:
    """What n bytes of 0 make of a register, as four tables by its bytes."""
    table = _crc_table()
    step = np.array([(1 << i) >> 8 ^ table[(1 << i) & 255] for i in range(32)], np.int64)
    whole = 1 << np.arange(32, dtype=np.int64)
    while n:
        if n & 1:
            whole = np.array([_through(step, int(c)) for c in whole], np.int64)
        step = np.array([_through(step, int(c)) for c in step], np.int64)
        n >>= 1
    return np.array([[_through(whole, v << 8 * k) for v in range(256)] for k in range(4)], np.int64)


#: Bytes from which on a checksum is taken of many parts at a time.
SIDE_BY_SIDE = 1 << 12


def crc32c(data: bytes) -> int:
    """The checksum; of long data the parts of equal length go side by side and are put together by what their length of zeros does."""
    table, crc = _crc_table(), 0xFFFFFFFF
    lanes = math.isqrt(len(data)) if len(data) >= SIDE_BY_SIDE else 0
    each = len(data) // lanes if lanes else 0
    head = len(data) - lanes * each
    for b in data[:head]:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    if lanes:
        parts = np.frombuffer(data, np.uint8, offset=head).reshape(lanes, each).T.astype(np.int64)
        lookup, states = np.array(table, np.int64), np.zeros(lanes, np.int64)
        for column in parts:
            states = states >> 8 ^ lookup[(states ^ column) & 255]
        low, second, third, high = _past(each).tolist()
        for state in states.tolist():
            crc = low[crc & 255] ^ second[crc >> 8 & 255] ^ third[crc >> 16 & 255] ^ high[crc >> 24] ^ state
    return crc ^ 0xFFFFFFFF


def _inflate(name: str, data: bytes) -> bytes:
    try:
        if name == "gzip":
            return zlib.decompress(data, 47)
        if name == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if name == "blosc":
            return blosc_unpacked(data)
    except CubeError:
        raise
    except Exception as e:
        raise CubeError("decode_error", f"{name}: {e}") from e
    raise CubeError("unsupported_codec", f"codec {name!r}")


def _deflate(codec: dict, data: bytes) -> bytes:
    name, conf = codec["name"], codec.get("configuration", {})
    if name == "gzip":
        z = zlib.compressobj(conf.get("level", 5), zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=conf.get("level", 3), write_checksum=bool(conf.get("checksum", False))).compress(data)
    if name == "crc32c":
        return data + struct.pack("<I", crc32c(data))
    if name == "blosc":
        return blosc_packed(data, conf)
    raise CubeError("unsupported_codec", f"codec {name!r}")


#: Fixed values of the blosc format: bits of the flags, inner codecs by number, and when a block is split by bytes.
SHUFFLED, COPIED, BIT_SHUFFLED, WHOLE = 1, 2, 4, 16
BLOSC = {1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_SPLITS, LEAST_SPLIT = 16, 128


def _inner(name: str, data: bytes, size: int) -> bytes:
    if name == "zlib":
        return zlib.decompress(data)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return pa.Codec("lz4_raw" if name == "lz4" else name).decompress(data, size).to_pybytes()


def _splits(flags: int, typesize: int, blocksize: int, last_short: bool) -> int:
    split = not flags & WHOLE and not last_short and typesize <= MOST_SPLITS and blocksize // typesize >= LEAST_SPLIT
    return typesize if split else 1


def _turned(block: bytes, typesize: int, back: bool) -> bytes:
    """Bytes of equal places of the elements side by side, or back; what is over stays."""
    n = len(block) // typesize
    whole = np.frombuffer(block, np.uint8, n * typesize).reshape((typesize, n) if back else (n, typesize))
    return whole.T.tobytes() + block[n * typesize :]


def blosc_unpacked(data: bytes) -> bytes:
    """The bytes of a blosc buffer, by its header: blocks, each of streams that may be split by byte and shuffled."""
    if len(data) < 16:
        raise CubeError("decode_error", "a blosc buffer without a header")
    flags, typesize, size, blocksize, packed = struct.unpack("<2xBBIII", data[:16])
    if packed != len(data):
        raise CubeError("decode_error", f"a blosc buffer of {len(data)} bytes that says {packed}")
    if flags & COPIED or not size:
        if len(data) != 16 + size:
            raise CubeError("decode_error", "a copied blosc buffer of another length")
        return data[16:]
    name = BLOSC.get(flags >> 5)
    if name is None or flags & BIT_SHUFFLED:
        raise CubeError("unsupported_codec", "blosc with blosclz or shuffled bits")
    out = []
    for i in range(-(-size // blocksize)):
        length = min(blocksize, size - i * blocksize)
        (at,) = struct.unpack_from("<I", data, 16 + 4 * i)
        streams = _splits(flags, typesize, blocksize, length < blocksize)
        parts = []
        for _ in range(streams):
            (n,) = struct.unpack_from("<I", data, at)
            raw = data[at + 4 : at + 4 + n]
            parts.append(raw if n == length // streams else _inner(name, raw, length // streams))
            at += 4 + n
        block = b"".join(parts)
        if len(block) != length:
            raise CubeError("decode_error", "a blosc block of another length")
        out.append(_turned(block, typesize, True) if flags & SHUFFLED and typesize > 1 else block)
    return b"".join(out)


def blosc_packed(data: bytes, conf: dict) -> bytes:
    """A blosc buffer; settings: cname (lz4, zlib or zstd), clevel, shuffle, typesize, blocksize (0: 32 KiB)."""
    name, level, typesize = conf.get("cname", "zstd"), conf.get("clevel", 5), conf.get("typesize", 1)
    number = next((k for k, v in BLOSC.items() if v == name), None)
    if number is None or name == "snappy" or conf.get("shuffle") == "bitshuffle":
        raise CubeError("unsupported_codec", f"blosc with {conf}")
    shuffle = conf.get("shuffle", "noshuffle") == "shuffle" and typesize > 1
    blocksize = min(conf.get("blocksize") or 1 << 15, len(data))
    blocksize = max(typesize, blocksize // typesize * typesize)
    flags = number << 5 | SHUFFLED * shuffle | WHOLE * (name != "lz4")

    def squeezed(raw: bytes) -> bytes:
        if name == "lz4":
            return pa.Codec("lz4_raw").compress(raw, asbytes=True)
        if name == "zlib":
            return zlib.compress(raw, level)
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(raw)

    blocks = []
    for lo in range(0, len(data), blocksize) if level else ():
        block = data[lo : lo + blocksize]
        streams = _splits(flags, typesize, blocksize, len(block) < blocksize)
        block = _turned(block, typesize, False) if shuffle else block
        each, parts = len(block) // streams, []
        for k in range(streams):
            raw = block[k * each : (k + 1) * each if k + 1 < streams else None]
            small = squeezed(raw)
            small = raw if len(small) >= len(raw) else small
            parts.append(struct.pack("<I", len(small)) + small)
        blocks.append(b"".join(parts))
    head = 16 + 4 * len(blocks)
    if not blocks or head + sum(map(len, blocks)) >= 16 + len(data):
        return struct.pack("<BBBBIII", 2, 1, flags | COPIED, typesize, len(data), blocksize, 16 + len(data)) + data
    starts = head + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    return struct.pack("<BBBBIII", 2, 1, flags, typesize, len(data), blocksize, int(starts[-1])) + starts[:-1].astype("<u4").tobytes() + b"".join(blocks)


def _checked(data: bytes) -> bytes:
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != crc32c(data[:-4]):
        raise CubeError("decode_error", "a checksum does not match")
    return data[:-4]


def split(codecs: list[dict]) -> tuple[list[tuple[int, ...]], dict, list[dict]]:
    """(transposes, the array-to-bytes codec, bytes codecs) of a chain."""
    orders, rest = [], list(codecs)
    while rest and rest[0]["name"] == "transpose":
        orders.append(tuple(rest.pop(0)["configuration"]["order"]))
    if not rest or rest[0]["name"] not in ("bytes", "sharding_indexed"):
        raise CubeError("unsupported_codec", "a chain needs the bytes or the sharding codec")
    return orders, rest[0], rest[1:]


def decode(data: bytes, codecs: list[dict], shape: tuple[int, ...], dtype: np.dtype, fill) -> np.ndarray:
    """The elements of one stored chunk."""
    orders, packer, outer = split(codecs)
    for codec in reversed(outer):
        data = _checked(data) if codec["name"] == "crc32c" else _inflate(codec["name"], data)
    stored = list(shape)
    for order in orders:
        stored = [stored[i] for i in order]
    if packer["name"] == "sharding_indexed":
        out = _decode_shard(data, packer["configuration"], tuple(stored), dtype, fill)
    else:
        kind = dtype
        if packer.get("configuration", {}).get("endian") == "big":
            kind = dtype.newbyteorder(">")
        n = int(np.prod(stored, dtype=np.int64))
        if len(data) != n * kind.itemsize:
            raise CubeError("decode_error", f"a chunk of {len(data)} bytes for {n * kind.itemsize}")
        out = np.frombuffer(data, kind).reshape(stored)
    for order in reversed(orders):
        out = out.transpose(np.argsort(order))
    return out


def encode(values: np.ndarray, codecs: list[dict]) -> bytes:
    orders, packer, outer = split(codecs)
    for order in orders:
        values = values.transpose(order)
    if packer["name"] == "sharding_indexed":
        data = _encode_shard(values, packer["configuration"])
    else:
        big = packer.get("configuration", {}).get("endian") == "big"
        data = np.ascontiguousarray(values.astype(values.dtype.newbyteorder(">" if big else "<"))).tobytes()
    for codec in outer:
        data = _deflate(codec, data)
    return data


def _grid(shape: tuple[int, ...], inner: tuple[int, ...]) -> tuple[int, ...]:
    if any(s % i for s, i in zip(shape, inner)):
        raise CubeError("invalid_metadata", "a shard is no multiple of its chunks")
    return tuple(s // i for s, i in zip(shape, inner))


def _index_codecs(conf: dict) -> list[dict]:
    return conf.get("index_codecs") or [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]


def _decode_shard(data: bytes, conf: dict, shape: tuple[int, ...], dtype: np.dtype, fill) -> np.ndarray:
    inner = tuple(conf["chunk_shape"])
    grid = _grid(shape, inner)
    codecs = _index_codecs(conf)
    size = 16 * int(np.prod(grid)) + 4 * sum(c["name"] == "crc32c" for c in codecs)
    raw = data[:size] if conf.get("index_location", "end") == "start" else data[-size:]
    index = decode(raw, codecs, (*grid, 2), np.dtype("<u8"), 0)
    out = np.full(shape, fill, dtype)
    for at in np.ndindex(*grid):
        offset, n = (int(x) for x in index[at])
        if offset == MISSING:
            continue
        if offset + n > len(data):
            raise CubeError("decode_error", "a shard's index points outside it")
        place = tuple(slice(a * i, (a + 1) * i) for a, i in zip(at, inner))
        out[place] = decode(data[offset : offset + n], conf["codecs"], inner, dtype, fill)
    return out


def _encode_shard(values: np.ndarray, conf: dict) -> bytes:
    inner = tuple(conf["chunk_shape"])
    grid, parts, at = _grid(values.shape, inner), [], 0
    index = np.full((*grid, 2), MISSING, np.uint64)
    for cell in np.ndindex(*grid):
        part = encode(values[tuple(slice(a * i, (a + 1) * i) for a, i in zip(cell, inner))], conf["codecs"])
        index[cell] = at, len(part)
        parts.append(part)
        at += len(part)
    return b"".join(parts) + encode(index, _index_codecs(conf))


def label(raw: bytes, big: bool = False) -> str:
    """A fixed-length UTF-32 label, to its first NUL."""
    points = np.frombuffer(raw, ">u4" if big else "<u4")
    end = np.flatnonzero(points == 0)
    points = points[: end[0]] if len(end) else points
    if ((points > 0x10FFFF) | ((points >= 0xD800) & (points < 0xE000))).any():
        raise CubeError("decode_error", "a label is not Unicode")
    return "".join(map(chr, points.tolist()))
