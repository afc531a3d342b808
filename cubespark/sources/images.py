"""The image schema: which nodes of a store are images, and what they are."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import CubeError
from ..model import Axis, CubeMeta
from . import codecs as cc
from .zarr import ArrayMeta, Node, Store, node_name

#: Fixed values of the schema; names that come first in a listing, in this order, and the group that does.
KNOWN_IMAGES = ("SKY", "SKY_MODEL", "SKY_RESIDUAL", "SKY_DIRTY", "POINT_SPREAD_FUNCTION", "PRIMARY_BEAM", "MASK")
FIRST_GROUP = "base"
SKY_TYPES, APERTURE_TYPES = ("sky", "point_spread_function", "primary_beam", "mask"), ("aperture", "visibility", "uv_sampling")
SCHEMA_ID, SCHEMA_VERSION = "xradio.image", "0.0.2"
SKY_DIMS, APERTURE_DIMS = ("l", "m", "frequency", "polarization", "time"), ("u", "v", "frequency", "polarization", "time")
ROLE_OF = {"l": "x", "u": "x", "m": "y", "v": "y", "frequency": "spectral", "polarization": "polarization", "time": "time"}
UNIX_EPOCH_MJD, SECONDS_A_DAY = 40587.0, 86400.0


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    node_path: str = ""


@dataclass(frozen=True)
class LinearAxis:
    """A linear description; reference_pixel counts from 1 and is None where there is none."""

    uniform: bool = False
    increment: float | None = None
    reference_value: float | None = None
    reference_pixel: float | None = None
    diagnostics: tuple[Diagnostic, ...] = ()

    def scaled(self, by: float) -> LinearAxis:
        return LinearAxis(self.uniform, None if self.increment is None else self.increment * by, self.reference_value, self.reference_pixel, self.diagnostics)


def fit_linear(values: list[float], reference: float | None = None, name: str = "") -> LinearAxis:
    """One coordinate's fit on the driver, by the rules of operators.axes.linear_fit."""
    if len(values) < 2:
        return LinearAxis()
    if not all(map(math.isfinite, values)):
        return LinearAxis(diagnostics=(Diagnostic("nonuniform_axis", "a sample is not finite", name),))
    first = values[1] - values[0]
    if first == 0:
        return LinearAxis(increment=0.0)
    steps = [b - a for a, b in zip(values[1:], values[2:])]
    uniform = all(abs(s - first) <= 1e-9 * max(1.0, abs(first), abs(s)) for s in steps)
    notes = () if uniform else (Diagnostic("nonuniform_axis", "the samples are not evenly spaced", name),)
    increment = (values[-1] - values[0]) / (len(values) - 1) if uniform and steps else first
    target = reference or 0.0
    at = min(range(len(values)), key=lambda i: abs(values[i] - target))
    if abs(values[at] - target) <= 1e-12 * max(1.0, *map(abs, values)):
        pixel = at + 1.0
    else:
        pixel = (target - values[0]) / increment + 1
        notes += (Diagnostic("inexact_reference_pixel", "no sample lies at the reference value", name),)
    return LinearAxis(uniform, increment, target, pixel, notes)


def fit_constructed(values: list[float], reference: float | None, scale: float, name: str) -> LinearAxis:
    """An axis that is linear by construction; one without a description is degenerate."""
    fit = fit_linear(values, reference, name).scaled(scale)
    if fit.reference_pixel is None:
        return LinearAxis(fit.uniform, fit.increment, None, None, (*fit.diagnostics, Diagnostic("degenerate_axis", "fewer than two distinct finite samples", name)))
    return fit


def fit_spectral(values: list[float], reference: float, name: str = "frequency") -> LinearAxis:
    """A spectral axis: one that is not even has no linear description."""
    fit = fit_linear(values, reference, name)
    return fit if fit.uniform else LinearAxis(diagnostics=tuple(d for d in fit.diagnostics if d.code == "nonuniform_axis"))


def text_of(attributes, *path: str) -> str:
    found = attributes
    for p in path:
        found = found.get(p) if isinstance(found, dict) else None
    return found if isinstance(found, str) else ""


def object_of(attributes, *path: str) -> dict:
    found = attributes
    for p in path:
        found = found.get(p) if isinstance(found, dict) else None
    return found if isinstance(found, dict) else {}


def numbers_of(found) -> list[float]:
    found = found.get("data") if isinstance(found, dict) else found
    if isinstance(found, (int, float)) and not isinstance(found, bool):
        return [float(found)]
    return [float(x) for x in found if isinstance(x, (int, float)) and not isinstance(x, bool)] if isinstance(found, list) else []


def plane_of(type_: str) -> str:
    return "sky" if type_ in SKY_TYPES else "aperture" if type_ in APERTURE_TYPES else ""


@dataclass(frozen=True)
class Listed:
    """An image of a listing, or a node that is reported (listed False)."""

    name: str
    listed: bool
    openable: bool
    malformed: bool
    diagnostics: tuple[Diagnostic, ...] = ()
    axes: tuple[Axis, ...] = ()


@dataclass
class Image:
    """A described image: axes, geometry, coordinates, flag and what its attributes tell."""

    name: str
    type: str
    unit: str
    cube: CubeMeta
    array: ArrayMeta
    flag: str | None
    groups: list[str]
    coordinates: dict[str, list]
    spectral: dict = field(default_factory=dict)
    temporal: dict = field(default_factory=dict)
    direction: dict = field(default_factory=dict)
    observation: dict = field(default_factory=dict)
    keywords: dict = field(default_factory=dict)
    diagnostics: list[Diagnostic] = field(default_factory=list)


class Dataset:
    """An opened store of images."""

    def __init__(self, path: str):
        self.path = path
        self.store = Store(path)
        self.nodes = {n.name: n for n in self.store.nodes()}
        self.groups = {g: {r: v for r, v in roles.items() if isinstance(v, str)} for g, roles in object_of(self.store.attributes, "data_groups").items() if isinstance(roles, dict)}
        self._images: dict[str, Image] = {}

    # -- recognition

    def version_refusal(self) -> Diagnostic | None:
        """Why the store is not of the version that is read, if it is not."""
        named = self.store.attributes.get("schema_version")
        if named is None:
            return Diagnostic("unsupported_schema_version", "the store names no schema version", "/attributes/schema_version")
        if named != SCHEMA_VERSION:
            return Diagnostic("unsupported_schema_version", f"schema {named} is not read; {SCHEMA_VERSION} is", "/attributes/schema_version")
        if not isinstance(self.store.attributes.get("data_groups"), dict):
            return Diagnostic("invalid_metadata", "the store has no data_groups", "/attributes/data_groups")
        sky = text_of(self.groups, FIRST_GROUP, "sky") or next((r["sky"] for _, r in sorted(self.groups.items()) if r.get("sky")), "")
        if sky and (sky not in self.nodes or self.nodes[sky].array is None):
            return Diagnostic("invalid_metadata", f"the data groups name {sky} as the sky, which is not an array", sky)
        frequency = self.nodes.get("frequency")
        if frequency and frequency.array and not (text_of(frequency.array.attributes, "frame") and text_of(frequency.array.attributes, "units")):
            return Diagnostic("invalid_metadata", "the frequency coordinate has no frame or no units", "frequency")
        return None

    def _contradiction(self, name: str, type_: str) -> Diagnostic | None:
        for group, roles in self.groups.items():
            for role, variable in roles.items():
                if plane_of(role) and role != type_:
                    try:
                        same = node_name(variable) == name
                    except CubeError:
                        same = False
                    if same:
                        return Diagnostic("invalid_metadata", f"data group {group} names it as its {role}, but it is typed {type_!r}", name)
        return None

    def _usable(self, flag: str, image: ArrayMeta) -> bool:
        node = self.nodes.get(flag)
        a = node.array if node else None
        return bool(a and text_of(a.attributes, "type") == "flag" and a.type_name == "bool" and a.dims == image.dims and a.shape == image.shape)

    def flag_of(self, name: str, image: ArrayMeta) -> str | None:
        """The flag of an image: declared by it, or by the data group whose sky it is, or found by name off the sky."""
        own = text_of(image.attributes, "flag")
        declared = [own] if own else sorted({r["flag"] for r in self.groups.values() if r.get("sky") == name and r.get("flag")})
        if len(declared) > 1:
            raise CubeError("invalid_metadata", f"data groups declare different flags: {declared}", name)
        if declared:
            if not self._usable(declared[0], image):
                raise CubeError("invalid_metadata", f"the declared flag {declared[0]} cannot mask this image", name)
            return declared[0]
        guess = f"FLAG_{name}"
        taken = any(r.get("flag") == guess for r in self.groups.values()) or any(n.array and text_of(n.array.attributes, "flag") == guess for n in self.nodes.values())
        return guess if text_of(image.attributes, "type") != "sky" and not taken and self._usable(guess, image) else None

    def qualify(self, node: Node) -> Listed | None:
        """What a node is in the listing; None for nodes that are passed over.  The first rule that holds decides."""
        if node.kind == "group":
            return None
        if node.array is None:
            code = "unrecognized_node" if node.kind == "unrecognized" else "unreadable_array"
            return Listed(node.name, False, False, True, (Diagnostic(code, node.error.message, node.name),))
        a, type_ = node.array, text_of(node.array.attributes, "type")
        plane = plane_of(type_)
        bad = lambda d, malformed=True: Listed(node.name, True, False, malformed, (d,), self._axes(a))
        say = lambda m, code="invalid_metadata": Diagnostic(code, m, node.name)
        if found := self._contradiction(node.name, type_):
            return bad(found)
        if type_ == "flag" or not plane:
            return None
        wanted = SKY_DIMS if plane == "sky" else APERTURE_DIMS
        if not set(wanted) <= set(a.dims):
            return bad(say(f"typed {type_!r}, but its dimensions are {a.dims}"))
        if a.type_name == "bool":
            return bad(say("boolean images are not openable", "unsupported_data_type"), False)
        if a.type_name not in cc.REAL:
            return bad(say(f"{a.type_name} images are not openable", "unsupported_data_type"), False)
        if len(a.dims) != 5:
            return bad(say(f"dimensions beyond the five of its plane: {a.dims}"))
        if plane == "aperture":
            for d in ("u", "v"):
                if d not in self.nodes or self.nodes[d].array is None:
                    return bad(say(f"the coordinate {d} is missing"))
        for d, n in zip(a.dims, a.shape):
            c = self.nodes.get(d)
            if c and c.array and len(c.array.shape) == 1 and c.array.shape[0] != n:
                return bad(say(f"{d} has {n} elements and its coordinate {c.array.shape[0]}"))
        try:
            self.flag_of(node.name, a)
        except CubeError as e:
            return bad(say(e.message))
        return Listed(node.name, True, True, False, (), self._axes(a))

    def _axes(self, a: ArrayMeta) -> tuple[Axis, ...]:
        """Axes in logical order."""
        wanted = APERTURE_DIMS if "u" in a.dims else SKY_DIMS
        known = [d for d in wanted if d in a.dims] + [d for d in a.dims if d not in wanted]
        return tuple(Axis(d, ROLE_OF.get(d, "other"), a.shape[a.dims.index(d)], a.dims.index(d)) for d in known)

    def _rank(self, name: str):
        own = [g for g, roles in self.groups.items() if name in roles.values()]
        group = min(((g != FIRST_GROUP, g) for g in own), default=(2, ""))
        return (int(group[0]), group[1], KNOWN_IMAGES.index(name) if name in KNOWN_IMAGES else len(KNOWN_IMAGES), name)

    def listing(self) -> list[Listed]:
        """Images in the order of the listing; the first that opens is the default."""
        found = [q for q in map(self.qualify, self.nodes.values()) if q and q.listed]
        return sorted(found, key=lambda q: self._rank(q.name))

    def diagnostics(self) -> list[Diagnostic]:
        """What stands against the dataset as a whole."""
        if refusal := self.version_refusal():
            return [refusal]
        found = [q for q in map(self.qualify, self.nodes.values()) if q]
        out = [d for q in found for d in q.diagnostics]
        planes = {plane_of(text_of(self.nodes[q.name].array.attributes, "type")) for q in found if q.openable}
        for plane in sorted(planes):
            for d in SKY_DIMS if plane == "sky" else APERTURE_DIMS:
                c = self.nodes.get(d)
                if not c or c.array is None or len(c.array.shape) != 1 or c.array.dims not in ((d,), ()) or c.array.type_name not in (*cc.REAL, "fixed_length_utf32"):
                    out.insert(0, Diagnostic("invalid_metadata", f"the coordinate {d} is missing or unusable", d))
        if "sky" in planes and not object_of(self.store.attributes, "coordinate_system_info"):
            out.insert(0, Diagnostic("invalid_metadata", "the store has no coordinate_system_info", "/attributes"))
        return out

    def match(self) -> str:
        """match, invalid or no_match."""
        if self.version_refusal():
            return "invalid" if self.store.attributes.get("type") == "image_dataset" or self.groups else "no_match"
        found = [q for q in map(self.qualify, self.nodes.values()) if q]
        against = [d for d in self.diagnostics() if d.node_path in (*SKY_DIMS, *APERTURE_DIMS, "/attributes")]
        if any(q.openable for q in found):
            return "invalid" if against else "match"
        return "invalid" if any(q.malformed and q.listed for q in found) else "no_match"

    def required(self) -> Dataset:
        """This dataset if it can be opened."""
        kind, why = self.match(), self.diagnostics()
        if kind == "match":
            return self
        first = why[0] if why else Diagnostic("unsupported_schema", "no image of a known schema")
        if kind == "no_match":
            raise CubeError("unsupported_schema", first.message, first.node_path)
        raise CubeError("unsupported_schema_version" if first.code == "unsupported_schema_version" else "invalid_schema", first.message, first.node_path)

    # -- description

    def default_image(self) -> str | None:
        return next((q.name for q in self.listing() if q.openable), None)

    def image(self, name: str) -> Image:
        if name not in self._images:
            self._images[name] = self._describe(name)
        return self._images[name]

    def _describe(self, name: str) -> Image:
        node = self.nodes.get(name)
        found = self.qualify(node) if node else None
        if found is None or not found.listed:
            raise CubeError("not_found", "no such image", name)
        if not found.openable:
            raise CubeError(found.diagnostics[0].code, found.diagnostics[0].message, name)
        a = self.store.verified(name)
        by_role = lambda shape: {ROLE_OF[d]: n for d, n in zip(a.dims, shape)}
        cube = CubeMeta(found.axes, by_role(a.chunk), by_role(a.shard) if a.shard else None, a.compressor)
        coordinates = {x.name: self.store.labels(x.name) if self.nodes[x.name].array.type_name == "fixed_length_utf32" else self.store.numbers(x.name).tolist() for x in found.axes}
        image = Image(name, text_of(a.attributes, "type"), text_of(a.attributes, "units"), cube, a, self.flag_of(name, a), sorted(g for g, r in self.groups.items() if name in r.values()), coordinates)
        self._spectral(image)
        self._temporal(image)
        self._direction(image)
        self._observation(image)
        self._keywords(image)
        return image

    def _attributes(self, name: str) -> dict:
        return self.nodes[name].array.attributes

    def _spectral(self, image: Image) -> None:
        about, values = self._attributes("frequency"), image.coordinates["frequency"]
        rest = numbers_of(about.get("rest_frequency"))
        reference = object_of(about, "reference_frequency").get("data", about.get("reference_value"))
        reference = float(reference) if isinstance(reference, (int, float)) else values[0]
        fit = fit_spectral(values, reference)
        width = None
        if len(values) == 1:
            w = object_of(self._attributes("frequency"), "channel_width")
            raw = w.get("data")
            if isinstance(raw, (int, float)) and math.isfinite(raw) and raw and text_of(w, "attrs", "units") in ("", text_of(about, "units")):
                width = float(raw)
        image.spectral = {"unit": text_of(about, "units"), "frame": text_of(about, "frame").upper(), "values": values, "rest_frequency": rest[0] if rest else None, "linear": fit, "channel_width": width}
        image.diagnostics += fit.diagnostics

    def _temporal(self, image: Image) -> None:
        about = self._attributes("time")
        image.temporal = {"values": image.coordinates["time"], "unit": text_of(about, "units"), "scale": text_of(about, "scale").upper(), "format": text_of(about, "format").upper()}

    def _direction(self, image: Image) -> None:
        if "u" in image.coordinates:
            out = {}
            for d in ("u", "v"):
                at = self._attributes(d).get("crval")
                if not isinstance(at, (int, float)):
                    image.diagnostics.append(Diagnostic("missing_reference", f"{d} has no crval; 0 is taken", d))
                fit = fit_constructed(image.coordinates[d], float(at) if isinstance(at, (int, float)) else 0.0, 1.0, d)
                image.diagnostics += fit.diagnostics
                out[d] = fit
            image.direction = out
            return
        info = object_of(self.store.attributes, "coordinate_system_info")
        matrix = info.get("pixel_coordinate_transformation_matrix")
        if not (isinstance(matrix, list) and len(matrix) == 2 and all(isinstance(r, list) and len(r) == 2 for r in matrix)):
            raise CubeError("invalid_metadata", "the pixel transformation is no 2 x 2 matrix", "/attributes/coordinate_system_info")
        equinox = text_of(info, "reference_direction", "attrs", "equinox")
        digits = re.fullmatch(r"[JBjb]?(\d+(?:\.\d*)?)", equinox)
        out = {
            "projection": text_of(info, "projection").upper(),
            "reference": [math.degrees(x) for x in numbers_of(info.get("reference_direction"))],
            "frame": text_of(info, "reference_direction", "attrs", "frame").upper(),
            "equinox": float(digits[1]) if digits else None,
            "native_pole": [math.degrees(x) for x in numbers_of(info.get("native_pole_direction"))],
            "parameters": numbers_of(info.get("projection_parameters")),
            "matrix": matrix,
        }
        for d in ("l", "m"):
            fit = fit_constructed(image.coordinates[d], None, math.degrees(1.0), d)
            image.diagnostics += fit.diagnostics
            out[d] = fit
        image.direction = out

    def _observation(self, image: Image) -> None:
        a = image.array.attributes
        site = numbers_of(object_of(a, "telescope").get("location") or object_of(a, "telescope", "direction"))
        place = None
        if len(site) == 3:
            lon, lat, radius = site
            place = [radius * math.cos(lat) * math.cos(lon), radius * math.cos(lat) * math.sin(lon), radius * math.sin(lat)]
        when = object_of(a, "obsdate")
        date = when.get("data")
        if isinstance(date, (int, float)):
            date = float(date) if text_of(when, "attrs", "format").lower() == "mjd" else UNIX_EPOCH_MJD + date / SECONDS_A_DAY
        else:
            date = None
        image.observation = {"object": text_of(a, "object_name"), "observer": text_of(a, "observer"), "telescope": text_of(a, "telescope", "name"), "position": place, "mjd": date, "pointing": [math.degrees(x) for x in numbers_of(a.get("pointing_center"))]}

    def _keywords(self, image: Image) -> None:
        """User keywords of the dataset and the image (the image's win), by name; kinds that have no place are left out."""
        merged = object_of(self.store.attributes, "user") | object_of(image.array.attributes, "user")
        for name in sorted(merged):
            v = merged[name]
            if isinstance(v, (bool, float, str)) or isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
                image.keywords[name] = v
            else:
                image.diagnostics.append(Diagnostic("unsupported_keyword", f"keyword {name} is left out", name))

    # -- tables

    def beam_rows(self, name: str) -> list[tuple[int, int, int, float, float, float]]:
        """(time, channel, polarization, major, minor, pa), time slowest; columns are found by label whatever its case."""
        node = self.nodes.get(f"BEAM_FIT_PARAMS_{name}") or self.nodes.get("BEAM_FIT_PARAMS")
        if node is None or node.array is None or "u" in self.image(name).coordinates:
            return []
        a = node.array
        at = {d: i for i, d in enumerate(a.dims)}
        labels = [x.lower() for x in self.store.labels("beam_params_label")]
        if len(labels) != a.shape[at["beam_params_label"]]:
            raise CubeError("invalid_metadata", "beam labels and parameters differ in number", node.name)
        try:
            columns = [labels.index(x) for x in ("major", "minor", "pa")]
        except ValueError:
            raise CubeError("invalid_metadata", f"beam labels {labels}", node.name) from None
        values = self.store.numbers(node.name)
        wide = lambda d: a.shape[at[d]] if d in at else 1
        out = []
        for t in range(wide("time")):
            for c in range(wide("frequency")):
                for p in range(wide("polarization")):
                    place = {"time": t, "frequency": c, "polarization": p}
                    cell = lambda k: float(values[tuple(k if d == "beam_params_label" else place[d] for d in a.dims)])  # noqa: B023, E731
                    out.append((t, c, p, *map(cell, columns)))
        return out

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.name, n.kind, list(n.array.shape) if n.array else None, list(n.array.dims) if n.array else None, n.array.type_name if n.array else None, n.error.code if n.error else None, n.error.message if n.error else None) for n in self.nodes.values()]
        return spark.createDataFrame(rows, "name string, kind string, shape array<bigint>, dims array<string>, data_type string, error_code string, error_message string")

    def beam_table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame(self.beam_rows(name), "time int, channel int, polarization int, major double, minor double, pa double")

    def coordinate_table(self, spark: SparkSession, name: str, axis: str) -> DataFrame:
        values = self.image(name).coordinates[axis]
        return spark.createDataFrame(list(enumerate(values)), f"idx int, value {'string' if values and isinstance(values[0], str) else 'double'}")


#: What opens a store of each known schema.
SCHEMAS: dict[str, type[Dataset]] = {SCHEMA_ID: Dataset}


@dataclass(frozen=True)
class Probe:
    """What a store is: supported, invalid, or without a supported schema; the schema that says so, and why."""

    kind: str
    schema_id: str | None
    diagnostics: tuple[Diagnostic, ...]


def probe_store(path: str, schemas: dict[str, type[Dataset]] | None = None) -> Probe:
    """Every known schema is asked once; more than one that matches is ambiguous, else the first that is not indifferent answers."""
    asked = [(name, kind(path)) for name, kind in (SCHEMAS if schemas is None else schemas).items()]
    answers = [(name, d.match(), tuple(d.diagnostics())) for name, d in asked]
    matches = [a for a in answers if a[1] == "match"]
    if len(matches) > 1:
        return Probe("invalid", None, (Diagnostic("ambiguous_schema", f"the store is of more than one schema: {', '.join(a[0] for a in matches)}"),))
    for kind, some in (("supported", matches), ("invalid", [a for a in answers if a[1] == "invalid"])):
        if some:
            return Probe(kind, some[0][0], some[0][2])
    return Probe("zarr_without_supported_schema", None, next((a[2] for a in answers if a[2]), ()))


def open_dataset(path: str) -> Dataset:
    found = probe_store(path)
    if found.kind == "invalid" and found.schema_id is None:
        raise CubeError("ambiguous_schema", found.diagnostics[0].message)
    return SCHEMAS[found.schema_id or SCHEMA_ID](path).required()


def probe(path: str, schema_id: str = SCHEMA_ID) -> tuple[str, list[Diagnostic]]:
    """(match, invalid or no_match; diagnostics) for one schema; an unknown schema is refused before the path is looked at."""
    if schema_id not in SCHEMAS:
        raise CubeError("unsupported_schema", f"schema {schema_id!r} is not known")
    found = SCHEMAS[schema_id](path)
    return found.match(), found.diagnostics()


def report(path: str) -> tuple[str, bool]:
    """One line of JSON about a store, and whether an image of it opens."""
    import json

    try:
        found = Dataset(path)
        kind = found.match()
        listed = [{"id": q.name, "openable": q.openable, "diagnostics": [d.__dict__ for d in q.diagnostics]} for q in found.listing()]
        return json.dumps({"match": kind, "images": listed, "diagnostics": [d.__dict__ for d in found.diagnostics()]}), kind == "match"
    except CubeError as e:
        return json.dumps({"error": e.code, "message": e.message, "node_path": e.node_path}), False
