"""Rewritten layouts, results as CSV, raw sinks, compression, SQL text."""

import io

import numpy as np
from fixtures import FLAGGED, SHARDED, pixels_store, stored
from test_sources import expected, refused, rows_of

from cubespark.model import Range
from cubespark.operators.layouts import differing_pixels
from cubespark.sources import cube, fits, images, results, rewrite, sql


def test_rewrite_crops_and_keeps_values(spark, tmp_path):
    path = pixels_store(tmp_path / "a")
    rewrite.rewrite(spark, path, str(tmp_path / "b"), "SKY", {"l": 3, "m": 2, "frequency": 2}, {"l": Range(1, 3), "frequency": Range(1, 1)}, codecs=None)
    got = rows_of(cube.load(spark, str(tmp_path / "b")))
    assert got == {(0, p, x - 1, y): expected(1, p, x, y) for p in range(2) for x in range(1, 4) for y in range(7)}
    image = images.open_dataset(str(tmp_path / "b")).image("SKY")
    assert image.coordinates["frequency"] == [1.2005e9] and len(image.coordinates["l"]) == 3 and image.array.chunk == (1, 1, 2, 3, 2)
    refused("invalid_argument", rewrite.rewrite, spark, path, path, "SKY", {})
    rewrite.rewrite(spark, path, str(tmp_path / "c"), "SKY", {"m": 1})
    assert differing_pixels(cube.load(spark, path), cube.load(spark, str(tmp_path / "c")), ["channel", "polarization", "y", "x"]).count() == 0


def test_results_round_trip(spark, tmp_path):
    names = [f.split()[0] for f in results.SCHEMA.replace("\n", " ").split(",")]
    base = dict.fromkeys(names)
    rows = [base | {"run_key": "k", "trial": t, "attempt": a, "process_index": 0, "op_index": i, "users": 1, "ops": 2, "status": "ok", "seconds": float(i + a), "shares_chunks": False, "mode": "plane"} for t, a, n in ((0, 0, 1), (0, 1, 2), (1, 0, 1)) for i in range(n)]
    results.write_results(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], results.SCHEMA), str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"))
    assert back.count() == 3 and back.filter("trial = 0 and attempt = 0").count() == 0
    assert [tuple(r) for r in results.complete_trials(back).collect()] == [("k", 0)]
    r = results.chunk_summary(back, ["mode"]).first()
    assert r.first_touches == 3 and r.median_s == 1.0 and r.p90_s == 2.0


def test_raw_sink_and_ordered_fingerprint(spark, tmp_path):
    path, out = pixels_store(tmp_path / "s"), io.BytesIO()
    assert results.write_raw(cube.load(spark, path, mask="false"), out) == 336
    values = np.frombuffer(out.getvalue(), np.float32)
    assert np.array_equal(values, stored()[0].transpose(1, 0, 3, 2).ravel(), equal_nan=True)
    odd = values.copy()
    odd.view(np.uint32)[np.isnan(odd)] = 0x7FC00001
    assert results.ordered_fingerprint(odd) == results.ordered_fingerprint(values) != results.ordered_fingerprint(values[::-1])
    assert results.ordered_fingerprint(np.zeros(0, np.float32)) == results.FNV_OFFSET


def test_fits_sink(spark, tmp_path):
    path, target = pixels_store(tmp_path / "s"), str(tmp_path / "cube.fits")
    image = images.open_dataset(path).image("SKY")
    assert fits.write_fits(cube.load(spark, path), image, target, path) == 336 and sorted(p.name for p in tmp_path.iterdir()) == ["cube.fits", "s"]
    cards, values = fits.read_fits(target)
    assert np.array_equal(values, np.where(FLAGGED, np.nan, stored())[0].transpose(1, 0, 3, 2), equal_nan=True)
    assert (cards["CTYPE1"], cards["CTYPE2"], cards["CRPIX1"], cards["CRVAL3"], cards["CDELT3"], cards["RADESYS"], cards["EQUINOX"]) == ("RA---TAN", "DEC--TAN", 4.0, 1.2e9, 5e5, "FK5", 1950.0) and "CTYPE4" not in cards
    assert fits.card("OBJECT", "it's") == b"OBJECT  = 'it''s   '".ljust(80)
    refused("invalid_argument", fits.write_fits, cube.load(spark, path), image, target, target)
    refused("invalid_argument", fits.write_fits, cube.load(spark, path, channels="0:1"), image, str(tmp_path / "short"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["cube.fits", "s"]


def test_compression_ratio(spark, tmp_path):
    plain = images.open_dataset(pixels_store(tmp_path / "a"))
    sharded = images.open_dataset(pixels_store(tmp_path / "b", codecs=SHARDED([1, 1, 1, 1, 2])))
    assert 0 < results.compression_ratio(spark, plain, "SKY") < 10 and 0 < results.compression_ratio(spark, sharded, "SKY") < 10
    refused("invalid_argument", results.refuse_overwrite, "a", "b", "a")


def test_sql_text(spark, tmp_path):
    sql.register(spark, pixels_store(tmp_path / "s"))
    n, total = spark.sql("SELECT count(*), sum(value) FROM pixels WHERE channel = 0 AND polarization = 1 AND NOT flagged").first()
    want = [expected(0, 1, x, y) for x in range(6) for y in range(7)]
    assert n == sum(v is not None for v in want) and total == sum(v for v in want if v is not None)
    rows = spark.sql("SELECT * FROM region_runs(1, 2, 3, 2, X'010001000101') ORDER BY y, x_begin").collect()
    assert [tuple(r) for r in rows] == [(2, 1, 2), (2, 3, 4), (3, 2, 4)]


def test_pieces_and_blocks_read_their_part_of_a_store(spark, tmp_path):
    """Watched reads and blocks load each part's chunks alone, and give what one read gives."""
    from cubespark.model import PlaneSelection, Region, Statistic
    from cubespark.operators import reduce, regions, selection
    from cubespark.streaming import progress

    path = pixels_store(tmp_path / "s")
    shape, asked = images.open_dataset(path).image("SKY").cube, []
    load = cube.reader(spark, path, "SKY")
    watched = lambda ranges: asked.append(cube.options_of(ranges)) or load(ranges)
    got = [r for piece in progress.read_in_pieces(watched, shape, selection.whole(shape), lambda a, b: True) for r in piece.to_pylist()]
    want = np.where(FLAGGED, np.nan, stored())[0].transpose(1, 0, 3, 2).ravel()
    assert np.array_equal(np.array([r["value"] for r in got], np.float32), want, equal_nan=True) and [a["channels"] for a in asked] == ["0:4:1"] * 2
    frame = regions.region_table(spark, [Region(0, 1, 1, 4, 5)], shape)
    runs, ids, planes = regions.runs_of(frame), frame.select("region_id"), PlaneSelection(Range(1, 3), 1)
    asked.clear()
    blocks = [r for _, b, _ in progress.reduce_in_blocks(watched, shape, runs, ids, planes, Statistic.sum, emit_every=2) for r in b.collect()]
    whole = reduce.spectral_reduce(cube.load(spark, path), shape, runs, ids, planes, Statistic.sum).collect()
    assert sorted(blocks) == sorted(whole) and [a["channels"] for a in asked] == ["1:2:1", "3:1:1"] and {a["polarizations"] for a in asked} == {"1:1:1"}


def test_workloads(spark, tmp_path):
    """Every mode runs its planned operations; the same positions give the same checksums in another layout, and results are complete."""
    from cubespark.operators import layouts, positions
    from cubespark.plans import workloads

    one, other = pixels_store(tmp_path / "a"), pixels_store(tmp_path / "b", l_fastest=True)
    modes = {"open": 1, "plane": 3, "spectrum": 2, "region": 2, "cube_histogram": 1, "animation": 1}
    settings = positions.Settings(fraction=0.2, frames=3)
    found = [workloads.trials(spark, p, modes, settings=settings, label=p[-1], seed=4) for p in (one, other)]
    rows = [r.collect() for r in found]
    assert [r["mode"] for r in rows[0]] == [m for m, n in modes.items() for _ in range(n)] and all(r.status == "ok" and r.seconds > 0 for some in rows for r in some)
    assert [(r.position, r.checksum, r.elements) for r in rows[0]] == [(r.position, r.checksum, r.elements) for r in rows[1]]
    plane = next(r for r in rows[0] if r["mode"] == "plane")
    channel, polarization = int(plane.position.split("chan=")[1].split(":")[0]), int(plane.position[4])
    want = np.where(FLAGGED, np.nan, stored())[0, channel, polarization].T.ravel().astype(np.float32)
    assert plane.checksum == workloads._sum(want) and plane.elements == 42
    played = next(r for r in rows[0] if r["mode"] == "animation")
    assert played.frames_played == 3 and played.frame_median_s <= played.frame_max_s
    both = found[0].unionByName(found[1])
    assert layouts.checksum_mismatches(both, ["mode", "position"]).count() == 0
    results.write_results(both, str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"))
    assert results.complete_trials(back).count() == 12 and layouts.summary(back.withColumn("setting", back["label"]), ["setting", "mode"]).count() == 12
    bad = workloads.trial(spark, one, "cube_histogram", settings=positions.Settings.histogram("sampled:2")).first()
    assert bad.method == "sampled" and bad.status == "ok"
