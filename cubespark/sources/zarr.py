"""Zarr v3 groups on a file system: nodes, array documents, chunks."""

from __future__ import annotations

import json
import os
import stat
import time
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from ..errors import CubeError
from . import codecs as cc

DOCUMENT = "zarr.json"


def location(path: str) -> Path:
    """A local folder from a plain path or a file:// one."""
    if "://" in path and not path.startswith("file://"):
        raise CubeError("unsupported_transport", f"{path.split('://')[0]}:// is not read")
    p = Path(path.removeprefix("file://"))
    if not p.exists():
        raise CubeError("not_found", f"{p} does not exist")
    if not p.is_dir():
        raise CubeError("not_zarr", f"{p} is not a folder")
    return p.resolve()


def node_name(name: str) -> str:
    """A node's name without empty and '.' parts; names that could leave the store are refused."""
    if name.startswith("/") or "\\" in name:
        raise CubeError("invalid_metadata", f"node name {name!r}")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise CubeError("invalid_metadata", f"node name {name!r}")
    return "/".join(parts)


def _lengths(x, what: str, least: int) -> tuple[int, ...]:
    if not isinstance(x, list) or any(isinstance(n, bool) or not isinstance(n, int) or n < least for n in x):
        raise CubeError("invalid_metadata", f"{what}: {x!r}")
    return tuple(x)


@dataclass(frozen=True)
class ArrayMeta:
    """What an array's document says.  shard is None unless chunks are gathered in shards."""

    shape: tuple[int, ...]
    dims: tuple[str, ...]
    data_type: object
    chunk: tuple[int, ...]
    shard: tuple[int, ...] | None
    codecs: list[dict]
    fill: object
    encoding: str
    separator: str
    compressor: str
    attributes: dict = field(default_factory=dict)

    @property
    def type_name(self) -> str:
        return self.data_type if isinstance(self.data_type, str) else self.data_type.get("name", "unknown")

    @property
    def stored(self) -> tuple[int, ...]:
        """The shape of what one file holds."""
        return self.shard or self.chunk

    @property
    def declared_bytes(self) -> int:
        return int(np.prod(self.shape, dtype=object)) * cc.dtype_of(self.data_type).itemsize

    def key(self, at: tuple[int, ...]) -> str:
        parts = list(map(str, at))
        return self.separator.join(["c", *parts]) if self.encoding == "default" else self.separator.join(parts) or "0"

    def fill_value(self, dtype: np.dtype):
        special = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}
        if dtype.kind == "V":
            return np.void((self.fill or "").encode("utf-32-le").ljust(dtype.itemsize, b"\0")) if isinstance(self.fill, str) else np.void(bytes(dtype.itemsize))
        return dtype.type(special.get(self.fill, self.fill) if isinstance(self.fill, str) else self.fill or 0)


def parse_array(doc: dict, node: str = "") -> ArrayMeta:
    """An array document by the format's rules; what breaks them is refused."""

    def refuse(why: str):
        raise CubeError("invalid_metadata", why, node)

    shape = _lengths(doc.get("shape"), "shape", 0)
    names = doc.get("dimension_names") or []
    if not isinstance(names, list) or any(not isinstance(n, str) for n in names) or len(set(names)) != len(names) or (names and len(names) != len(shape)):
        refuse(f"dimension_names {names!r}")
    kind = doc.get("data_type")
    if not (isinstance(kind, str) or isinstance(kind, dict) and isinstance(kind.get("name"), str)):
        refuse(f"data_type {kind!r}")
    grid = doc.get("chunk_grid")
    if not isinstance(grid, dict) or grid.get("name") != "regular":
        refuse("only the regular chunk grid is known")
    chunk = _lengths(grid.get("configuration", {}).get("chunk_shape"), "chunk_shape", 1)
    if len(chunk) != len(shape):
        refuse("chunk_shape and shape differ in rank")
    chain = doc.get("codecs")
    if not isinstance(chain, list) or any(not isinstance(c, dict) or not isinstance(c.get("name"), str) for c in chain):
        refuse(f"codecs {chain!r}")
    order = list(range(len(shape)))
    shard, inner, named = None, chunk, []
    for c in chain:
        conf = c.get("configuration", {})
        if c["name"] == "transpose":
            if sorted(conf.get("order", [])) != list(range(len(shape))):
                refuse("a transpose that is no permutation")
            order = [order[i] for i in conf["order"]]
        elif c["name"] == "sharding_indexed":
            found = _lengths(conf.get("chunk_shape"), "inner chunk_shape", 1)
            if len(found) != len(shape):
                refuse("inner chunks differ in rank")
            shard = chunk
            inner = tuple(n for _, n in sorted(zip(order, found)))
            named += [x.get("name") for x in conf.get("codecs", [])]
        named.append(c["name"])
    encoding = doc.get("chunk_key_encoding") or {"name": "default"}
    scheme = encoding.get("name", "default")
    if scheme not in ("default", "v2"):
        refuse(f"chunk keys {scheme!r}")
    separator = encoding.get("configuration", {}).get("separator", "/" if scheme == "default" else ".")
    if separator not in ("/", "."):
        refuse(f"separator {separator!r}")
    attributes = doc.get("attributes") or {}
    if not isinstance(attributes, dict):
        refuse("attributes are no object")
    return ArrayMeta(shape, tuple(names), kind, inner, shard, chain, doc.get("fill_value"), scheme, separator, next((n for n in cc.COMPRESSORS if n in named), ""), attributes)


@dataclass(frozen=True)
class Node:
    """kind: group, array or unrecognized; error: why a document does not parse."""

    name: str
    kind: str
    array: ArrayMeta | None = None
    error: CubeError | None = None


class Store:
    """One Zarr v3 group: its documents, read once each, and its chunks."""

    def __init__(self, path: str):
        self.root = location(path)
        raw = self.root / DOCUMENT
        if not raw.is_file():
            raise CubeError("not_zarr", f"{self.root} has no {DOCUMENT}")
        self.document = self._json(raw.read_bytes(), "")
        if self.document.get("zarr_format") != 3:
            raise CubeError("unsupported_zarr_version", f"zarr_format {self.document.get('zarr_format')!r}")
        if self.document.get("node_type") != "group":
            raise CubeError("invalid_metadata", "the root is not a group")
        self.attributes = self.document.get("attributes") or {}
        self.consolidated = self._flatten(self.document.get("consolidated_metadata"))
        self._known: dict[str, ArrayMeta | CubeError] = {}
        self._verified: set[str] = set()

    @staticmethod
    def _json(raw: bytes, node: str) -> dict:
        try:
            found = json.loads(raw)
        except ValueError as e:
            raise CubeError("invalid_metadata", f"the document is no JSON: {e}", node) from e
        if not isinstance(found, dict):
            raise CubeError("invalid_metadata", "the document is no object", node)
        return found

    @staticmethod
    def _flatten(block) -> dict[str, dict] | None:
        if block is None:
            return None
        entries = block.get("metadata") if isinstance(block, dict) else None
        if not isinstance(entries, dict):
            raise CubeError("invalid_metadata", "consolidated_metadata has no metadata")
        out: dict[str, dict] = {}

        def take(found: dict, above: str):
            for key, doc in found.items():
                name = node_name("/".join(filter(None, [above, key.lstrip("/").removesuffix(DOCUMENT).rstrip("/")])))
                if name in out:
                    raise CubeError("invalid_metadata", "consolidated twice", name)
                out[name] = doc
                deeper = doc.get("consolidated_metadata") if isinstance(doc, dict) else None
                if isinstance(deeper, dict):
                    take(deeper.get("metadata") or {}, name)

        take(entries, "")
        return out

    def own_document(self, node: str) -> dict:
        path = self.root / node_name(node) / DOCUMENT
        try:
            return self._json(path.read_bytes(), node)
        except FileNotFoundError:
            raise CubeError("not_found", "no such node", node) from None
        except OSError as e:
            raise CubeError("io_error", str(e), node) from e

    def array(self, node: str) -> ArrayMeta:
        """The array's document; answers and refusals are remembered, failures to read are not."""
        node = node_name(node)
        known = self._known.get(node)
        if known is None:
            try:
                doc = (self.consolidated or {}).get(node) or self.own_document(node)
                if doc.get("node_type") != "array":
                    raise CubeError("invalid_metadata", "not an array", node)
                known = parse_array(doc, node)
            except CubeError as e:
                if e.code in ("io_error", "cancelled"):
                    raise
                known = e
            self._known[node] = known
        if isinstance(known, CubeError):
            raise known
        return known

    def verified(self, node: str) -> ArrayMeta:
        """The array, once its consolidated copy has been held to its own document."""
        meta = self.array(node)
        if self.consolidated and node not in self._verified:
            own = parse_array(self.own_document(node), node)
            for what in ("shape", "dims", "data_type", "chunk", "shard", "attributes"):
                if getattr(own, what) != getattr(meta, what):
                    raise CubeError("invalid_metadata", f"the consolidated {what} differs from its own {DOCUMENT}", node)
        self._verified.add(node)
        return meta

    def _walk(self) -> list[str]:
        out, seen = [], set()
        todo = [(self.root, "")]
        while todo:
            folder, name = todo.pop()
            real = os.path.realpath(folder)
            if real in seen:
                continue
            seen.add(real)
            document = folder / DOCUMENT
            if name and document.is_file():
                out.append(name)
                try:
                    if json.loads(document.read_bytes()).get("node_type") == "array":
                        continue  # chunks are no nodes
                except (ValueError, AttributeError, OSError):
                    pass
            try:
                todo += [(p, f"{name}/{p.name}".lstrip("/")) for p in folder.iterdir() if p.is_dir()]
            except OSError:
                continue
        return out

    def nodes(self) -> list[Node]:
        """Every node, by name."""
        out = []
        for name in sorted(set(self.consolidated if self.consolidated is not None else self._walk())):
            try:
                doc = (self.consolidated or {}).get(name) or self.own_document(name)
            except CubeError as e:
                if e.code == "io_error":
                    raise
                out.append(Node(name, "unrecognized", error=e))
                continue
            kind = doc.get("node_type") if isinstance(doc, dict) else None
            if kind == "group":
                out.append(Node(name, "group"))
            elif kind != "array":
                out.append(Node(name, "unrecognized", error=CubeError("invalid_metadata", f"node_type {kind!r}", name)))
            else:
                try:
                    out.append(Node(name, "array", self.array(name)))
                except CubeError as e:
                    out.append(Node(name, "array", error=e))
        return out

    def stored_bytes(self, end: float | None = None) -> int:
        """The sizes of all regular files; ``cancelled`` once the clock passes end, ``io_error`` if a folder does not list or the sum is no signed 64-bit number."""

        def fail(e: OSError):
            raise CubeError("io_error", str(e)) from e

        total = 0
        for folder, _, names in os.walk(self.root, onerror=fail):
            for n in names:
                if end is not None and time.monotonic() > end:
                    raise CubeError("cancelled", "the files were not counted in time")
                try:
                    found = os.lstat(os.path.join(folder, n))
                except OSError as e:
                    fail(e)
                if stat.S_ISREG(found.st_mode):
                    total += found.st_size
        if total >= 1 << 63:
            raise CubeError("io_error", "the files' sizes overflow")
        return total

    def declared_bytes(self) -> int:
        """What all arrays hold decoded; an array that does not parse refuses."""
        return sum(self.array(x.name).declared_bytes for x in self.nodes() if x.kind == "array")

    def size(self, timeout: float = 0.05) -> tuple[int, str]:
        """(bytes, "measured") by walking the files, or the arrays' declared bytes if that takes too long or fails."""
        try:
            return self.stored_bytes(time.monotonic() + timeout), "measured"
        except CubeError:
            return self.declared_bytes(), "declared"

    def chunk(self, node: str, meta: ArrayMeta, at: tuple[int, ...]) -> np.ndarray:
        """One stored chunk or shard in full size; one that was never written holds the fill value."""
        dtype = cc.dtype_of(meta.data_type)
        fill = meta.fill_value(dtype)
        path = self.root / node / meta.key(at)
        try:
            raw = path.read_bytes()
        except FileNotFoundError:
            return np.full(meta.stored, fill, dtype)
        except OSError as e:
            raise CubeError("io_error", str(e), node) from e
        return cc.decode(raw, meta.codecs, meta.stored, dtype, fill)

    def box(self, node: str, meta: ArrayMeta, begin: tuple[int, ...], end: tuple[int, ...]) -> np.ndarray:
        """Elements of a box, ends exclusive, from the chunks that it touches."""
        out = np.empty([b - a for a, b in zip(begin, end)], cc.dtype_of(meta.data_type))
        spans = [range(a // n, -(-b // n)) for a, b, n in zip(begin, end, meta.stored)]
        for cell in np.ndindex(*map(len, spans)):
            at = tuple(s[i] for s, i in zip(spans, cell))
            part = self.chunk(node, meta, at)
            low = [max(a, c * n) for a, c, n in zip(begin, at, meta.stored)]
            high = [min(b, (c + 1) * n) for b, c, n in zip(end, at, meta.stored)]
            out[tuple(slice(x - a, y - a) for x, y, a in zip(low, high, begin))] = part[tuple(slice(x - c * n, y - c * n) for x, y, c, n in zip(low, high, at, meta.stored))]
        return out

    def numbers(self, node: str) -> np.ndarray:
        """A whole array of a real type as doubles."""
        meta = self.verified(node)
        if meta.type_name not in cc.REAL:
            raise CubeError("unsupported_data_type", f"{meta.type_name} is not a real type", node)
        return self.box(node, meta, (0,) * len(meta.shape), meta.shape).astype(np.float64)

    def at(self, node: str, **indices: int) -> float:
        """One element of an array of a real type by the names of its dimensions; 0 where one is not named."""
        meta = self.verified(node)
        if meta.type_name not in cc.REAL:
            raise CubeError("unsupported_data_type", f"{meta.type_name} is not a real type", node)
        if len(meta.dims) != len(meta.shape):
            raise CubeError("invalid_metadata", "the dimensions have no names", node)
        for name, i in indices.items():
            if name not in meta.dims:
                raise CubeError("invalid_slice", f"no dimension {name}", node)
            if not 0 <= i < meta.shape[meta.dims.index(name)]:
                raise CubeError("invalid_slice", f"index {i} is outside {name}", node)
        begin = tuple(indices.get(d, 0) for d in meta.dims)
        return float(self.box(node, meta, begin, tuple(i + 1 for i in begin)).ravel()[0])

    def labels(self, node: str) -> list[str]:
        """A one-dimensional array of labels."""
        meta = self.verified(node)
        if meta.type_name != "fixed_length_utf32" or len(meta.shape) != 1:
            raise CubeError("unsupported_data_type", "labels are one-dimensional and of fixed length", node)
        _, packer, _ = cc.split(meta.codecs)
        big = packer.get("configuration", {}).get("endian") == "big"
        plain = {**packer, "configuration": {**packer.get("configuration", {}), "endian": "little"}}
        meta = ArrayMeta(**{**meta.__dict__, "codecs": [plain if c is packer else c for c in meta.codecs]})
        whole = self.box(node, meta, (0,), meta.shape)
        return [cc.label(x.tobytes(), big) for x in whole]
