"""An image as a FITS file of 32-bit floats."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.pixels import folded
from ..session import reachable
from .images import Image
from .results import ordered_values, refuse_overwrite

#: Fixed values of the format: bytes of a card and of a block; codes of polarizations.
CARD, BLOCK = 80, 2880
#: Values that a task holds at once.
VALUES = 1 << 18
STOKES = {"I": 1, "Q": 2, "U": 3, "V": 4, "RR": -1, "LL": -2, "RL": -3, "LR": -4, "XX": -5, "YY": -6, "XY": -7, "YX": -8}


def card(key: str, value) -> bytes:
    if isinstance(value, bool):
        said = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        said = f"{value:>20}"
    elif isinstance(value, float):
        said = f"{value!r:>20}".replace("e", "E")
    else:
        said = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {said}".ljust(CARD).encode("ascii", "replace")[:CARD]


def header(image: Image) -> bytes:
    """The cards of an image: lengths, axes, unit; polarizations that are not known or not even have no description."""
    lengths = [image.cube.length(r) for r in ("x", "y", "spectral", "polarization")]
    cards = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 4), *((f"NAXIS{i}", n) for i, n in enumerate(lengths, 1)), ("BUNIT", image.unit)]
    d, spectral = image.direction, image.spectral
    if "l" in d:
        for i, axis, kind in ((1, "l", "RA"), (2, "m", "DEC")):
            fit, name = d[axis], f"{kind}{'-' * (5 - len(kind))}{d['projection']}"
            cards += [(f"CTYPE{i}", name), (f"CUNIT{i}", "deg")]
            if fit.reference_pixel is not None and len(d["reference"]) == 2:
                cards += [(f"CRPIX{i}", float(fit.reference_pixel)), (f"CDELT{i}", float(fit.increment)), (f"CRVAL{i}", float(d["reference"][i - 1]))]
        cards.append(("RADESYS", d["frame"]))
        if d["equinox"]:
            cards.append(("EQUINOX", float(d["equinox"])))
    cards += [("CTYPE3", "FREQ"), ("CUNIT3", spectral["unit"])]
    fit = spectral["linear"]
    step = fit.increment if fit.reference_pixel is not None else spectral["channel_width"]
    if step:
        cards += [("CRPIX3", float(fit.reference_pixel or 1)), ("CDELT3", float(step)), ("CRVAL3", float(fit.reference_value if fit.reference_pixel is not None else spectral["values"][0]))]
    if spectral["rest_frequency"]:
        cards.append(("RESTFRQ", float(spectral["rest_frequency"])))
    codes = [STOKES.get(x) for x in image.coordinates.get("polarization", [])]
    if codes and None not in codes and len({b - a for a, b in zip(codes, codes[1:])}) <= 1:
        cards += [("CTYPE4", "STOKES"), ("CRPIX4", 1.0), ("CDELT4", float(codes[1] - codes[0]) if len(codes) > 1 else 1.0), ("CRVAL4", float(codes[0]))]
    raw = b"".join(card(*c) for c in cards) + b"END".ljust(CARD)
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def write_fits(pixels: DataFrame, image: Image, target: str, *inputs: str, time: int = 0) -> int:
    """Writes the pixels of one time, NaN where they are flagged or missing data; returns how many.

    The file is written beside its place and renamed, so a place holds a whole file or none; a place among the
    inputs is refused, and so is a relation that has not one row for each pixel.
    """
    refuse_overwrite(os.path.realpath(target), *map(os.path.realpath, inputs))
    wanted, n = int(np.prod([image.cube.length(r) for r in ("x", "y", "spectral", "polarization")], dtype=object)), 0
    beside = Path(target).with_name(f".{uuid.uuid4().hex}")
    try:
        with beside.open("wb") as out:
            out.write(header(image))
            for part in ordered_values(pixels.filter(F.col("time") == time).withColumn("value", folded(F.col("value"), F.col("flagged"))), ">f4"):
                out.write(part)
                n += len(part) // 4
            out.write(bytes(-4 * n % BLOCK))
        if n != wanted:
            raise CubeError("invalid_argument", f"{n} pixels for an image of {wanted}")
        beside.replace(target)
    finally:
        beside.unlink(missing_ok=True)
    return n


def read_fits(path: str) -> tuple[dict[str, object], np.ndarray]:
    """(cards, values in logical order reversed: polarization, channel, y, x) of such a file."""
    raw = np.memmap(path, np.uint8, "r")
    cards, at = {}, 0
    while not (line := raw[at : at + CARD].tobytes().decode("ascii")).startswith("END "):
        key, text, at = line[:8].strip(), line[10:].strip(), at + CARD
        cards[key] = text[1:-1].replace("''", "'").strip() if text.startswith("'") else text == "T" if text in ("T", "F") else float(text) if any(c in text for c in ".E") else int(text)
    start = -(-(at + CARD) // BLOCK) * BLOCK
    shape = [cards[f"NAXIS{i}"] for i in range(cards["NAXIS"], 0, -1)]
    return cards, np.frombuffer(raw, ">f4", int(np.prod(shape)), start).reshape(shape)


def pixels_of(spark: SparkSession, path: str) -> DataFrame:
    """The values of such a file with their places, read piece by piece in tasks, which must see it as a file."""
    pieces = -(-read_fits(path)[1].size // VALUES)

    def read(batches):
        _, values = read_fits(path)
        flat = values.reshape(-1)
        for batch in batches:
            for first in (n * VALUES for n in batch.column("id").to_pylist()):
                part = flat[first : first + VALUES]
                places = np.unravel_index(np.arange(first, first + len(part)), values.shape)
                yield pa.RecordBatch.from_pydict(dict(zip(("polarization", "channel", "y", "x"), map(pa.array, places))) | {"value": pa.array(part.astype(np.float64))})

    return reachable(spark).range(0, pieces, 1, max(1, min(pieces, 100_000))).mapInArrow(read, "polarization bigint, channel bigint, y bigint, x bigint, value double")
