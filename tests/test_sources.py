"""Stores, codecs, recognition, description and the pixel relation, on stores written by formula."""

import json
import math

import numpy as np
import pytest
from fixtures import DRAWN, FLAGGED, FREQUENCIES, GZIP, SHAPE, SHARDED, SYSTEM, beam, coordinates, minimal_store, pixels_store, stored

from cubespark.errors import CubeError
from cubespark.model import CubeMeta, Range
from cubespark.operators import selection
from cubespark.session import Context, shared_folder
from cubespark.sources import codecs, cube, images, sink, writer, zarr


def refused(code, call, *a, **k):
    with pytest.raises(CubeError) as e:
        call(*a, **k)
    assert e.value.code == code, e.value
    return e.value


def expected(f, p, x, y, mask=True):
    v = stored()[0, f, p, x, y]
    return None if np.isnan(v) or mask and FLAGGED[0, f, p, x, y] else float(v)


def rows_of(frame, mask=True):
    return {(r.channel, r.polarization, r.x, r.y): None if math.isnan(r.value) or mask and r.flagged else r.value for r in frame.collect()}


LAYOUTS = {
    "plain": {},
    "l_fastest": {"l_fastest": True},
    "gzip": {"codecs": GZIP},
    "fine_flag": {"flag_chunk": (1, 1, 1, 1, 7)},
    "coarse_flag": {"flag_chunk": SHAPE},
    "consolidated": {"consolidate": True},
    "sharded": {"codecs": SHARDED([1, 1, 1, 1, 2])},
    "transposed": {"codecs": [{"name": "transpose", "configuration": {"order": [4, 3, 2, 1, 0]}}, *writer.ZSTD, {"name": "crc32c"}]},
    "blosc": {"codecs": [*writer.PLAIN, {"name": "blosc", "configuration": {"cname": "zstd", "clevel": 3, "shuffle": "shuffle", "typesize": 4, "blocksize": 0}}]},
}
EVERY = list(np.ndindex(*SHAPE[1:]))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_pixels_of_every_layout(spark, tmp_path, layout):
    path = pixels_store(tmp_path / "s", **LAYOUTS[layout])
    assert rows_of(cube.load(spark, path)) == {k: expected(*k) for k in EVERY}
    assert rows_of(cube.load(spark, path, mask="false"), False) == {k: expected(*k, mask=False) for k in EVERY}


def test_selections_read_their_chunks_only(spark, tmp_path):
    path = pixels_store(tmp_path / "s")
    one = cube.load(spark, path, channels="1:2:2", polarizations="0:2", x="1:2:3", y="0:3:2", budgetBytes=1)
    got = rows_of(one)
    assert set(got) == {(f, p, x, y) for f in (1, 3) for p in (0, 1) for x in (1, 4) for y in (0, 2, 4)} and all(v == expected(*k) for k, v in got.items())
    image = images.open_dataset(path).image("SKY")
    whole = selection.whole(image.cube)
    scan = cube.plan_scan(image, whole)
    assert scan.count == 4 * 2 * 2 * 2 and len({scan.box(i) for i in range(scan.count)}) == 32 and cube.decoded_chunk_bytes(image) == 12 * 5
    assert cube.plan_scan(image, whole, {(1, 0), (9, 9)}).count == 8 and cube.plan_scan(image, whole, {(1, 0)}).box(0) == ((0, 0, 0, 3, 0), (1, 1, 1, 6, 4))
    assert len(scan.partitions(budget=2 * 3 * 60)) == 16 and len(scan.partitions(least=5)) == 6 and len(scan.partitions()) == 1
    assert [(c.first, c.last) for c in scan.partitions(budget=11 * 3 * 60)] == [(0, 11), (11, 22), (22, 32)]
    sparse = cube.plan_scan(image, selection.whole(image.cube, x=Range(0, 2, 5), spectral=Range(1, 2, 2)))
    assert sparse.count == 2 * 2 * 2 * 2 and {sparse.box(i)[0][1] for i in range(sparse.count)} == {1, 3}
    # Two selections in one plan do not disturb each other.
    a, b = cube.load(spark, path, channels="0:1"), cube.load(spark, path, channels="1:1")
    assert a.union(b).count() == 168 and a.join(b, ["polarization", "x", "y"]).count() == 84


def test_a_scan_of_very_many_chunks_lists_none(tmp_path):
    """Ten thousand million chunks: a bounded number of tasks, and any chunk's box by its number."""
    wide = cube.Scan(("time", "spectral", "polarization", "x", "y"), {r: cube.Span(Range(0, n), 4) for r, n in (("time", 4), ("spectral", 400_000), ("polarization", 4), ("x", 1280), ("y", 1280))}, None, 1 << 10)
    assert wide.count == 100_000 * 320 * 320
    tasks = wide.partitions()
    assert len(tasks) <= cube.MOST_TASKS and tasks[-1].last == wide.count
    assert wide.box(wide.count - 1) == ((0, 399_996, 0, 1276, 1276), (4, 400_000, 4, 1280, 1280))


def test_read_budget():
    """Two chunks a thread, each held three times, within bounds."""
    assert cube.read_budget(1) == cube.read_budget(1 << 20, 8) == 256 << 20 and cube.read_budget(64 << 20, 2) == 3 * 4 * (64 << 20) and cube.read_budget(64 << 20, 28) == 2 << 30
    assert cube.read_budget(0, 0) == 256 << 20


def test_refused_selections(spark, tmp_path):
    path = pixels_store(tmp_path / "s")
    for option in ({"channels": "0:5"}, {"channels": "0:1:0"}, {"x": "-1:1"}, {"y": "nonsense"}):
        with pytest.raises(Exception, match="invalid_slice"):
            cube.load(spark, path, **option).count()
    with pytest.raises(Exception, match="not_found"):
        cube.load(spark, path, image="NONE").count()


def test_described_image(tmp_path):
    image = images.open_dataset(pixels_store(tmp_path / "s", attributes={"object_name": "M 1", "obsdate": {"data": 86400.0, "attrs": {"format": "unix"}}, "telescope": {"name": "T", "location": {"data": [0.0, math.pi / 2, 6e6]}}})).image("SKY")
    assert [(a.name, a.role, a.length, a.storage_index) for a in image.cube.axes] == [("l", "x", 6, 3), ("m", "y", 7, 4), ("frequency", "spectral", 4, 1), ("polarization", "polarization", 2, 2), ("time", "time", 1, 0)]
    assert image.unit == "Jy/beam" and image.flag == "FLAG" and image.groups == ["base"] and image.cube.fastest_spatial == "y" and image.cube.compressor == "zstd"
    assert image.coordinates["polarization"] == ["XX", "Y"] and image.coordinates["frequency"] == list(FREQUENCIES)
    d = image.direction
    assert d["projection"] == "TAN" and d["equinox"] == 1950.0 and d["l"].reference_pixel == 4.0 and d["m"].reference_pixel == 2.0 and math.isclose(d["l"].increment, math.degrees(0.002))
    assert image.spectral["linear"].uniform and image.spectral["rest_frequency"] == 1.2e9 and image.temporal["scale"] == "TAI"
    assert image.observation["mjd"] == 40588.0 and math.isclose(image.observation["position"][2], 6e6)


def test_listing_beams_and_keywords(spark, tmp_path):
    dataset = images.open_dataset(minimal_store(tmp_path / "m"))
    assert [(q.name, q.openable) for q in dataset.listing()] == [("SKY", True), ("SKY_MODEL", True), ("SKY_RESIDUAL", True), ("MASK", True), ("APERTURE", False), ("COMPLEX", False)]
    assert dataset.default_image() == "SKY"
    rows = dataset.beam_table(spark, "SKY").collect()
    assert len(rows) == 10 and all(np.allclose((r.major, r.minor, r.pa), beam(r.channel, r.polarization)) for r in rows)
    assert math.isclose(dataset.store.at("BEAM_FIT_PARAMS_SKY", frequency=3, polarization=1, beam_params_label=2), beam(3, 1)[0])
    for bad in ({"row": 0}, {"frequency": 5}, {"frequency": -1}):
        refused("invalid_slice", dataset.store.at, "BEAM_FIT_PARAMS_SKY", **bad)
    refused("unsupported_data_type", dataset.store.at, "COMPLEX")
    image = dataset.image("SKY")
    assert image.keywords == {"a": 1, "e": "x", "f": True, "g": 1.5} and not image.spectral["linear"].uniform
    assert {d.code for d in image.diagnostics} >= {"unsupported_keyword", "nonuniform_axis"}
    assert dataset.beam_rows("SKY_MODEL") == [] and dataset.node_table(spark).filter("kind = 'array'").count() == len(dataset.nodes)
    assert refused("unsupported_data_type", dataset.image, "COMPLEX") and refused("not_found", dataset.image, "frequency")
    total = cube.load(spark, str(tmp_path / "m"), "SKY_RESIDUAL").groupBy("channel").sum("value").collect()
    assert {r[1] for r in total} == {48.0}


def test_store_refusals(tmp_path):
    refused("unsupported_transport", zarr.Store, "s3://bucket/x")
    refused("not_found", zarr.Store, str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    refused("not_zarr", zarr.Store, str(tmp_path / "file"))
    refused("not_zarr", zarr.Store, f"file://{tmp_path}")
    for text, code in (("{", "invalid_metadata"), ("[]", "invalid_metadata"), ('{"zarr_format": 2}', "unsupported_zarr_version"), ('{"zarr_format": 3, "node_type": "array"}', "invalid_metadata")):
        (tmp_path / "zarr.json").write_text(text)
        refused(code, zarr.Store, str(tmp_path))
    for name in ("", "..", "a/../b", "/a", "a\\b"):
        refused("invalid_metadata", zarr.node_name, name)
    assert zarr.node_name("./a//b") == "a/b"


@pytest.mark.parametrize(
    "change",
    [{"shape": [1, -1]}, {"dimension_names": ["a", "a"]}, {"dimension_names": ["a"]}, {"data_type": 3}, {"chunk_grid": {"name": "odd"}}, {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [0, 1]}}}, {"codecs": "x"}, {"codecs": [{"name": "transpose", "configuration": {"order": [0, 0]}}]}, {"chunk_key_encoding": {"name": "odd"}}],
)
def test_array_documents(change):
    good = {"shape": [2, 3], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 3]}}, "codecs": writer.ZSTD, "dimension_names": ["a", "b"], "fill_value": "NaN"}
    assert zarr.parse_array(good).declared_bytes == 24
    refused("invalid_metadata", zarr.parse_array, good | change)


def test_consolidated_copy_is_held_to_the_document(tmp_path):
    path = pixels_store(tmp_path / "s", consolidate=True)
    own = tmp_path / "s" / "SKY" / "zarr.json"
    doc = json.loads(own.read_text())
    own.write_text(json.dumps(doc | {"shape": [*SHAPE[:4], 9]}))
    refused("invalid_metadata", images.open_dataset(path).image, "SKY")


def test_schema_refusals(tmp_path):
    cases = {
        "no_version": ({"schema_version": None}, "unsupported_schema_version"),
        "other": ({"schema_version": "1.0"}, "unsupported_schema_version"),
        "contradiction": ({"data_groups": {"base": {"mask": "SKY"}}}, "invalid_schema"),
        "no_system": ({"coordinate_system_info": None}, "invalid_schema"),
    }
    for name, (group, code) in cases.items():
        refused(code, images.open_dataset, pixels_store(tmp_path / name, group=group))
    writer.write_group(tmp_path / "bare", {})
    assert refused("unsupported_schema", images.open_dataset, str(tmp_path / "bare"))
    refused("unsupported_schema", images.probe, "/nowhere", "other")
    assert images.probe(pixels_store(tmp_path / "good"))[0] == "match"
    line, opens = images.report(str(tmp_path / "good"))
    assert opens and json.loads(line)["images"][0]["id"] == "SKY" and not images.report("/nowhere")[1]


def test_declared_flags(tmp_path):
    root = tmp_path / "s"
    pixels_store(root, attributes={"flag": "l"})
    q = next(q for q in images.Dataset(str(root)).listing() if q.name == "SKY")
    assert not q.openable and q.malformed


def test_labels(tmp_path):
    for i, (chain, keys) in enumerate([(writer.PLAIN, None), (GZIP, {"name": "v2", "configuration": {"separator": "."}}), ([*writer.ZSTD, {"name": "crc32c"}], None)]):
        writer.write_group(tmp_path / str(i), {})
        writer.write_array(tmp_path / str(i) / "x", ["A", "BC", "Ω🙂"], ("x",), (2,), codecs=chain, keys=keys)
        assert zarr.Store(str(tmp_path / str(i))).labels("x") == ["A", "BC", "Ω🙂"]
    chunk = tmp_path / "2" / "x" / "c" / "0"
    chunk.write_bytes(chunk.read_bytes()[:-1] + b"\0")
    refused("decode_error", zarr.Store(str(tmp_path / "2")).labels, "x")
    chunk.unlink()
    assert zarr.Store(str(tmp_path / "2")).labels("x") == ["", "", "Ω🙂"]
    refused("decode_error", codecs.label, np.array([0xD800], "<u4").tobytes())
    assert codecs.crc32c(b"123456789") == 0xE3069283


def test_checksums_side_by_side(monkeypatch):
    """Parts that go side by side give the checksum of one run over all bytes."""
    data = np.random.default_rng(3).bytes(70_001)
    found = [codecs.crc32c(data[:n]) for n in (0, 5, 4095, 4096, 4097, 10_000, 70_001)]
    monkeypatch.setattr(codecs, "SIDE_BY_SIDE", 1 << 40)
    assert found == [codecs.crc32c(data[:n]) for n in (0, 5, 4095, 4096, 4097, 10_000, 70_001)]


@pytest.mark.parametrize(("cname", "size"), [("zstd", 4), ("zlib", 8), ("lz4", 4), ("zstd", 1)])
def test_blosc(cname, size):
    """Blocks that are split and not, shuffled and not, a short last block, raw parts and a raw buffer."""
    rnd = np.random.default_rng(5)
    for n, shuffle, block in ((1000, "shuffle", 1024), (5000, "noshuffle", 4096), (37, "shuffle", 0), (0, "shuffle", 0), (4096, "shuffle", 1 << 14)):
        for raw in (rnd.integers(0, 9, n * size, np.uint8).tobytes(), rnd.bytes(n * size)):
            packed = codecs.blosc_packed(raw, {"cname": cname, "shuffle": shuffle, "typesize": size, "blocksize": block, "clevel": 3})
            assert codecs.blosc_unpacked(packed) == raw
    stored_ = codecs.blosc_packed(b"abcd" * 9, {"cname": cname, "shuffle": "shuffle", "typesize": 4, "clevel": 0})
    assert stored_[2] & 2 and codecs.blosc_unpacked(stored_) == b"abcd" * 9
    refused("decode_error", codecs._inflate, "blosc", stored_[:-1])
    refused("unsupported_codec", codecs.blosc_unpacked, bytes([2, 1, 0, 4, 36, 0, 0, 0, 36, 0, 0, 0, 40, 0, 0, 0]) + bytes(24))


def test_size(tmp_path):
    root = tmp_path / "s"
    store = zarr.Store(pixels_store(root))
    declared = sum(store.array(n.name).declared_bytes for n in store.nodes())
    measured = sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    (root / "pipe").symlink_to(root / "SKY" / "zarr.json")  # not a regular file
    assert store.size(10) == (measured, "measured") == (store.stored_bytes(), "measured") and store.size(-1) == (declared, "declared")
    refused("cancelled", store.stored_bytes, 0.0)


def test_written_images_read_back(spark, tmp_path):
    """The sink: in files of any shape, sharded or not, holes left out, flags beside them."""
    path = pixels_store(tmp_path / "a")
    pixels, was = cube.load(spark, path, mask="true"), images.open_dataset(path).image("SKY").cube
    sink.write_image(pixels, f"file://{tmp_path}/b", "SKY", was, {"x": 4, "y": 7, "spectral": 1}, {"type": "sky", "flag": "F"}, SHARDED([1, 1, 2, 2, 7]))
    sink.write_image(pixels, f"file://{tmp_path}/b", "F", was, {"spectral": 3}, {"type": "flag"}, column="flagged")
    coordinates(tmp_path / "b", {})
    writer.write_group(tmp_path / "b", {"type": "image_dataset", "schema_version": "0.0.2", "data_groups": {"base": {"sky": "SKY"}}, "coordinate_system_info": SYSTEM})
    assert rows_of(cube.load(spark, str(tmp_path / "b"))) == {k: expected(*k) for k in EVERY}
    empty = CubeMeta(was.axes, was.chunk)
    sink.write_image(pixels.withColumn("value", sink.F.lit(float("nan")).cast("float")), str(tmp_path / "c"), "SKY", empty, {"x": 3})
    assert [p.name for p in (tmp_path / "c" / "SKY").rglob("*") if p.is_file()] == ["zarr.json"]
    refused("unsupported_transport", sink.write_image, pixels, "s3://x", "SKY", was, {})


def test_shared_folder():
    """The setting is taken; without one a folder of this machine, but not on a cluster."""
    from types import SimpleNamespace as Stub

    none = Stub(isDefined=lambda: False)
    session = lambda master, root=None: Stub(conf=Stub(get=lambda k, d: root), sparkContext=Stub(master=master, _jsc=Stub(sc=lambda: Stub(getCheckpointDir=lambda: none))))
    assert shared_folder(session("spark://a:1", "hdfs://x/y/"), "w").startswith("hdfs://x/y/w-") and shared_folder(session("local[3]"), "w").startswith("file:///tmp/checkpoints/w-")
    refused("invalid_argument", shared_folder, session("local-cluster[2,1,1024]"), "w")


def test_context():
    assert Context().settings().get("spark.master") is None and Context().storage is None
    made = Context(1 << 30, 4, 6)
    assert made.settings()["spark.master"] == "local[6]" and made.settings()["spark.driver.memory"] == "4096m" and made.storage.useMemory
    refused("invalid_argument", Context, -1)


def test_linear_fits():
    fit = images.fit_linear([-0.002, -0.001, 0.0, 0.001])
    assert fit.uniform and fit.reference_pixel == 3 and math.isclose(fit.increment, 0.001)
    fit = images.fit_linear([1.0, 2.0, 3.0])
    assert fit.reference_pixel == 0 and [d.code for d in fit.diagnostics] == ["inexact_reference_pixel"]
    assert [d.code for d in images.fit_constructed([1.0, 1.0], None, 1.0, "l").diagnostics] == ["degenerate_axis"]
    assert [d.code for d in images.fit_linear([1.0, math.nan]).diagnostics] == ["nonuniform_axis"]
    assert images.fit_spectral([1.0, 2.0, 4.0], 1.0).reference_pixel is None


def test_rounded_mantissa():
    """Nearest of the numbers with few bits, ties to even, by search among them."""
    v = np.array([1.0, 1 + 2**-10, 1 + 2**-9, np.nan, np.inf, -np.inf, 0.0, -0.0], np.float32)
    out = writer.rounded_mantissa(v, 9)
    assert out[0] == 1 and out[1] == 1 and out[2] == v[2] and np.isnan(out[3]) and out[4] == np.inf and out[5] == -np.inf and not out[6:].any()
    rnd = np.random.default_rng(1)
    some = (rnd.normal(size=500) * 10.0 ** rnd.integers(-44, 38, 500)).astype(np.float32)
    assert (writer.rounded_mantissa(some, 23) == some).all() and (writer.rounded_mantissa(some, 30) == some).all()
    for bits in (0, 3, 11):
        got = writer.rounded_mantissa(some, bits).view(np.uint32).astype(np.int64)
        raw, step = some.view(np.uint32).astype(np.int64), 1 << 23 - bits
        low = raw // step * step
        near = np.where(raw - low < low + step - raw, low, np.where(raw - low > low + step - raw, low + step, np.where(low // step % 2, low + step, low)))
        assert (got == near).all()
    assert np.isinf(writer.rounded_mantissa(np.array([np.finfo(np.float32).max]), 3)[0])


def test_range_checks():
    assert Range(3, 1, 7).checked(4) == Range(3, 1, 1) and Range(0, 4, 2).checked(7).last == 6
    for bad in (Range(0, 0), Range(0, 1, 0), Range(-1, 2), Range(0, 4, 2)):
        refused("invalid_slice", bad.checked, 6)
    assert DRAWN.shape == SHAPE
