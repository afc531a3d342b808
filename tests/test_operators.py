"""Regions, statistics and histograms against numpy, on cubes by formula."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import refused

from cubespark.functions.pixels import Bins
from cubespark.model import CubeMeta, PlaneSelection, Range, Region, Statistic
from cubespark.operators import histogram, layouts, positions, reduce, regions, selection
from cubespark.sources.synthetic import Sky, cube_of, formula, line_cube

NX, NY, NC = 17, 13, 5
CUBE = cube_of(NX, NY, NC, chunk={"x": 4, "y": 5, "spectral": 2})


def data():
    c, y, x = np.indices((NC, NY, NX))
    v = ((x * 7 + y * 13 + c * 29) % 31 - 11).astype(np.float32) * np.float32(0.37)
    v = np.where((x + 2 * y + c) % 11 == 0, np.float32(np.nan), np.where((x * y + c) % 37 == 5, np.float32(np.inf), v))
    v[3] = np.nan
    return v, (x + y) % 4 == 0


@pytest.fixture(scope="module")
def pixels(spark):
    def value(x, y, c, p, t):
        v = (((x * 7 + y * 13 + c * 29) % 31 - 11).cast("float") * F.lit(0.37).cast("float")).cast("float")
        nan, inf = F.lit(float("nan")).cast("float"), F.lit(float("inf")).cast("float")
        return F.when((c == 3) | ((x + 2 * y + c) % 11 == 0), nan).when((x * y + c) % 37 == 5, inf).otherwise(v)

    return formula(spark, CUBE, value, lambda x, y, c, p, t: (x + y) % 4 == 0).persist()


def masks(rnd, w, h):
    return bytes(rnd.integers(0, 2, w * h, dtype=np.uint8).tolist())


REGIONS = [Region(0, 0, 0, NX, NY), Region(1, 3, 2, 9, 8, masks(np.random.default_rng(1), 9, 8)), Region(2, 5, 5, 4, 4, bytes(16)), Region(3, 16, 12, 1, 1), Region(4, 2, 0, 12, 13, bytes(int((x - 6) ** 2 + (y - 6) ** 2 <= 30) for y in range(13) for x in range(12)))]


def inside(r):
    out = np.zeros((NY, NX), bool)
    out[r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = True if not r.mask else np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) != 0
    return out


@pytest.mark.parametrize(("parts", "mask"), [(1, True), (4, True), (16, False)])
def test_statistics(spark, pixels, parts, mask):
    v, flag = data()
    frame = regions.region_table(spark, REGIONS, CUBE)
    planes = PlaneSelection(Range(0, 3, 2))
    found = reduce.spectral_reduce(pixels.repartition(parts), CUBE, regions.runs_of(frame), frame.select("region_id"), planes, mask=mask).collect()
    assert len(found) == len(REGIONS) * 3
    for r in found:
        some = v[r.sel_channel * 2][inside(REGIONS[r.region_id])].astype(float)
        bad = ~np.isfinite(some) | (flag[0][inside(REGIONS[r.region_id])] if mask else False)
        good = some[~bad]
        assert (r.num_pixels, r.nan_count) == (len(good), bad.sum())
        assert math.isclose(r.sum, good.sum(), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.sum_sq, (good**2).sum(), rel_tol=1e-9)
        if len(good):
            assert (r.min, r.max) == (good.min(), good.max()) and math.isclose(r.sum_sq_dev, ((good - good.mean()) ** 2).sum(), rel_tol=1e-10, abs_tol=1e-9)
        else:
            assert math.isnan(r.min) and math.isnan(r.max) and r.sum_sq_dev == 0


def test_statistics_asked_for(spark, pixels):
    frame = regions.region_table(spark, REGIONS, CUBE)
    run = lambda s: reduce.spectral_reduce(pixels, CUBE, regions.runs_of(frame), frame.select("region_id"), PlaneSelection(Range(1, 1)), s)
    assert run(Statistic.max).columns == ["region_id", "sel_channel", "max"]
    assert run(Statistic.sum_sq_dev).columns == ["region_id", "sel_channel", "num_pixels", "sum", "sum_sq_dev"]
    refused("invalid_argument", run, Statistic(0))
    for planes in (PlaneSelection(Range(4, 2)), PlaneSelection(Range(0, 1), 1), PlaneSelection(Range(0, 1), 0, -1)):
        refused("invalid_slice", planes.checked, CUBE)
    refused("not_implemented", CubeMeta(CUBE.axes[1:]).mapped)


def test_spread_far_from_zero(spark):
    """Values about 1e6 with a spread near 1, in several tasks, beside exact arithmetic; float32 keeps them apart by 1/16."""
    from fractions import Fraction

    v = (1e6 + np.random.default_rng(6).normal(0, 1, 20_000)).astype(np.float32).astype(float)
    assert len(np.unique(v)) > 50
    whole = [Fraction(x) for x in v.tolist()]
    mean = sum(whole) / len(whole)
    want = float(sum((x - mean) ** 2 for x in whole))
    frame = spark.createDataFrame([(0, x) for x in v.tolist()], "g int, v double").repartition(7)
    got = frame.groupBy("g").agg(*reduce.aggregates(Statistic.sum_sq_dev)).first().sum_sq_dev
    assert 15_000 < want < 25_000 and math.isclose(got, want, rel_tol=1e-10)


def test_plan_of_the_reduction_has_one_scan(spark, tmp_path):
    """One file scan, one shuffle of pixels, and no join but that with the runs."""
    spark.createDataFrame([(0, 0, c, y, x, float(x), False) for c in range(2) for y in range(4) for x in range(4)], "time int, polarization int, channel int, y int, x int, value float, flagged boolean").write.parquet(str(tmp_path / "p"))
    cube = cube_of(4, 4, 2)
    frame = regions.region_table(spark, [Region(0, 0, 0, 4, 4)], cube)
    found = reduce.spectral_reduce(spark.read.parquet(str(tmp_path / "p")), cube, regions.runs_of(frame), frame.select("region_id"), PlaneSelection(Range(0, 2)), most_runs=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 1


def test_blocks(spark, pixels):
    frame = regions.region_table(spark, REGIONS[:2], CUBE)
    found = reduce.spectral_reduce(pixels, CUBE, regions.runs_of(frame), frame.select("region_id"), PlaneSelection(Range(0, 4)), Statistic.max)
    block, rows = reduce.Block.of(found, 3), {(r.region_id, r.sel_channel): r.max for r in found.collect()}
    assert block.carries(Statistic.max) and not block.carries(Statistic.sum) and block.first_channel == 3
    for r in (0, 1):
        assert np.array_equal(block.series(r, Statistic.max), [rows[r, c] for c in range(4)], equal_nan=True)
        t = block.totals(r, 1)
        assert t["max"] == rows[r, 1] and t["sum"] == 0 and math.isnan(t["min"]) and list(t) == [s.name for s in Statistic]
    refused("invalid_slice", block.totals, 0, 4)


def test_order_statistics_are_exact(spark):
    """Ranks by running counts as by sorting, with ties, nulls, infinities, one value and none."""
    rnd = np.random.default_rng(9)
    groups = {"many": rnd.integers(0, 40, 501).astype(float).tolist(), "even": [3.0, 1.0, 2.0, float("inf")], "one": [5.0], "none": [None, None], "some": [None, 2.0, 7.0]}
    frame = spark.createDataFrame([(g, v) for g, some in groups.items() for v in some], "g string, v double").repartition(3)
    found = {r.g: r for r in layouts.order_statistics(frame, ["g"], "v").collect()}
    for g, some in groups.items():
        v = sorted(x for x in some if x is not None)
        if not v:
            assert (found[g].median, found[g].p90, found[g].upper_median) == (None, None, None)
            continue
        assert found[g].median == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 and found[g].p90 == v[math.ceil(0.9 * len(v)) - 1] and found[g].upper_median == v[len(v) // 2]


def test_robust_noise(spark):
    rnd, rows = np.random.default_rng(4), []
    for c in range(4):
        v = np.round(rnd.normal(c, 1 + c, 300), 1 if c % 2 else 6)
        v[:c] = 1000
        rows += [(c, float(x)) for x in v] + [(c, float("nan"))] * (c + 1)
    rows += [(9, float("nan")), (9, float("inf"))]
    found = {r.channel: r for r in layouts.robust_noise(spark.createDataFrame(rows, "channel int, value double"), ["channel"]).collect()}
    for c in range(4):
        v = np.array([x for k, x in rows if k == c and math.isfinite(x)])
        d = np.abs(v - np.median(v))
        rms = np.median(d) * 1.4826
        assert math.isclose(found[c].nan_fraction, (c + 1) / (301 + c)) and math.isclose(found[c].rms, rms) and math.isclose(found[c].beyond, (d > 5 * rms).mean())
    assert (found[9].nan_fraction, found[9].rms, found[9].beyond) == (1.0, None, None)
    told = layouts.noise_summary(spark.createDataFrame([tuple(r) for r in found.values()], "channel int, nan_fraction double, rms double, beyond double")).first()
    assert (told.channels, told.all_nan_channels) == (5, 1) and math.isclose(told.rms, np.median([found[c].rms for c in range(4)]))
    cube = spark.createDataFrame([(0, 0, c, y, x, float("nan") if x < 2 and c == 1 else 1.0) for c in range(2) for y in range(3) for x in range(4)], "time int, polarization int, channel int, y int, x int, value float")
    assert tuple(layouts.nan_chunks(cube, {"x": 2, "y": 2, "spectral": 1}).first()) == (8, 2)


def test_shared_chunks(spark):
    """Boxes of any size beside comparing all pairs; empty ones share nothing."""
    rnd, boxes = np.random.default_rng(8), []
    for i in range(60):
        low, size = rnd.integers(0, 12, 3), rnd.integers(0 if i % 9 == 0 else 1, 4, 3)
        boxes.append((i % 4, i, *(int(v) for a, s in zip(low, size) for v in (a, a + s))))
    frame = spark.createDataFrame(boxes, "process int, op int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int").repartition(3)
    meet = lambda a, b: all(max(a[k], b[k]) < min(a[k + 1], b[k + 1]) for k in (2, 4, 6))
    want = {(a[0], a[1]): any(meet(a, b) and (a[0] != b[0] or b[1] < a[1]) for b in boxes if b is not a) for a in boxes}
    assert {(r.process, r.op): r.shares_chunks for r in layouts.shared_chunks(frame).collect()} == want


def test_positions(spark):
    """Streams, prefixes, distinct positions, runs of processes, and boxes of each mode."""
    words = positions.split_mix(0)
    assert [next(words) for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]  # published test values
    draw = lambda n, pool: positions.distinct_sample(positions.stream_of(3, "plane", 0, 1), pool, n)
    assert sorted(v for v, _ in draw(50, 50)) == list(range(50)) and draw(20, 50) == draw(50, 50)[:20]
    again = draw(7, 5)
    assert [v for v, _ in again[5:]] == [v for v, _ in again[:2]] and [o for _, o in again] == [True, True, False, False, False, True, True]
    far = draw(2000, 1 << 40)
    assert len({v for v, _ in far}) == 2000 and max(v for v, _ in far) < 1 << 40 and draw(100, 1 << 40) == far[:100] and draw(2, 0) == [(0, False)] * 2
    cube = cube_of(40, 30, 12, 2, chunk={"x": 8, "y": 8, "spectral": 4})
    for mode in positions.MODES:
        one, two = positions.plan(mode, cube, 5, 1, 1, 3), positions.plan(mode, cube, 5, 1, 2, 3)
        if mode not in ("cube_histogram", "open"):
            same = lambda some: [(o.x, o.y, o.width, o.height, o.channel, o.channels, o.polarization) for o in some]
            assert same(two[:3]) == same(one) and len({(o.x, o.y, o.channel, o.polarization) for o in two}) == (6 if mode != "animation" else 2)
        assert [(o.process, o.op) for o in two] == [(p, k) for p in range(2) for k in range(3)]
        for o in two:
            for role, r in o.ranges(cube).items():
                r.checked(cube.length(role), role)
    assert [(o.channel, o.channels) for o in positions.plan("cube_histogram", cube, processes=5)] == [(0, 2), (2, 2), (4, 3), (7, 2), (9, 3)]
    assert all(o.overlap for o in positions.plan("cube_histogram", cube, processes=13))
    region = positions.plan("region", cube, settings=positions.Settings(fraction=0.25))[0]
    assert (region.width, region.height, region.channels) == (20, 15, 12)
    rows = positions.operations(spark, positions.plan("plane", cube, 1, 0, 2, 12), cube)
    shared = layouts.shared_chunks(rows).collect()
    assert len(shared) == 24 and all(r.shares_chunks for r in shared if r.process == 1) and positions.Settings.histogram("sampled:4").stride == 4
    for bad in ("sampled", "exact:2", "none", "sampled:x"):
        refused("invalid_argument", positions.Settings.histogram, bad)
    refused("invalid_argument", positions.plan, "plane", cube, processes=0)


def test_profiles_and_sky(spark):
    from cubespark.functions import sky

    x = np.linspace(-20, 20, 4001)
    g, h = sky.gaussian(x, 6.0), sky.double_horn(x, 10.0, 0.5, 0.4)
    assert math.isclose(g.max(), 1) and math.isclose(np.ptp(x[g >= 0.5 - 1e-9]), 6.0, abs_tol=0.02)
    middle = len(x) // 2
    assert math.isclose(h[middle], 0.6, rel_tol=1e-6) and h.max() > 0.8 and abs(h[0]) < 1e-9 and np.allclose(h, h[::-1]) and 3.5 < abs(x[h.argmax()]) < 5
    ra, dec = sky.orthographic(F.col("l"), F.col("m"), 1.0, 0.5)
    some = [(0.0, 0.0), (0.1, -0.2), (-0.3, 0.05)]
    back = spark.createDataFrame(some, "l double, m double").select("l", "m", (F.cos(dec) * F.sin(ra - 1.0)).alias("a"), (F.sin(dec) * math.cos(0.5) - F.cos(dec) * math.sin(0.5) * F.cos(ra - 1.0)).alias("b")).collect()
    assert all(math.isclose(r.l, r.a, abs_tol=1e-12) and math.isclose(r.m, r.b, abs_tol=1e-12) for r in back)
    place = spark.range(1).select(*sky.cartesian(F.lit(0.3), F.lit(-0.2), F.lit(2.0))).first()
    assert math.isclose(sum(v * v for v in place), 4.0)


def test_regions_refused(spark):
    for r, code in ((Region(0, 0, 0, 0, 1), "invalid_slice"), (Region(0, 16, 0, 2, 1), "invalid_slice"), (Region(0, 0, 0, 2, 2, b"abc"), "invalid_argument")):
        refused(code, regions.region_table, spark, [r], CUBE)
    refused("invalid_argument", regions.region_table, spark, [], CUBE)


def test_runs_islands_and_occupancy(spark):
    frame = regions.region_table(spark, REGIONS, CUBE)
    runs = regions.runs_of(frame)
    cells = [(r.region_id, int(x), int(y)) for r in REGIONS for y, x in zip(*np.nonzero(inside(r)))]
    islands = regions.islands(spark.createDataFrame(cells, "region_id int, x int, y int")).collect()
    key = lambda rows: sorted((r.region_id, r.y, r.x_begin, r.x_end) for r in rows)
    assert key(runs.collect()) == key(islands)
    occupied = regions.occupancy(runs, 4, 5)
    want = {(i, x // 4, y // 5) for i, x, y in cells}
    assert {tuple(r) for r in occupied.collect()} == want
    index = {(r.cx, r.cy): r.regions for r in regions.chunk_index(occupied).collect()}
    assert index == {c: sorted(i for i, *k in want if tuple(k) == c) for c in {(x, y) for _, x, y in want}}
    refused("invalid_argument", regions.chunk_index, occupied, 3)
    for budget in (1, 2, 3, 100):
        rects = regions.footprints(occupied, budget).collect()
        seen = [(x, y) for r in rects for x in range(r.cx0, r.cx1) for y in range(r.cy0, r.cy1)]
        assert sorted(seen) == sorted(index) and all((r.cx1 - r.cx0) * (r.cy1 - r.cy0) <= budget for r in rects)


def test_contained_both_ways(spark, pixels):
    runs = regions.runs_of(regions.region_table(spark, REGIONS, CUBE))
    key = ["region_id", "channel", "y", "x"]
    few = regions.contained(pixels, runs).select(*key)
    many = regions.contained(pixels, runs, broadcast_rows=0).select(*key)
    assert few.count() == NC * sum(inside(r).sum() for r in REGIONS) and few.exceptAll(many).count() == 0 and many.count() == few.count()


@pytest.mark.parametrize(("n", "low", "high"), [(7, -3.0, 4.0), (50, -1.0, 1.0), (1, -100.0, 100.0), (3, 0.5, 0.5000000001), (4, -3e38, 3e38)])
def test_plane_histogram(pixels, n, low, high):
    v, flag = data()
    bins = Bins(n, low, high)
    found = {r.sel_channel: r.counts for r in histogram.dense_rows(histogram.plane_histogram(pixels, CUBE, bins, PlaneSelection(Range(0, NC)))).collect()}
    for c in range(NC):
        some = v[c][~flag[0]]
        assert found[c] == np.bincount(bins.of(some[~np.isnan(some)]), minlength=n).tolist()


def test_bins_refused():
    for a in ((0, 0, 1), (5, 1, 1), (5, 0, math.inf), (5, 0, 1e39), (1 << 21, 0, 1), (5, math.nan, 1)):
        refused("invalid_argument", Bins, *a)


@pytest.mark.parametrize("every", [1, 3])
def test_cube_histograms(spark, pixels, every):
    v, flag = data()
    some = v[:, ::every, ::every][np.isfinite(v[:, ::every, ::every]) & ~flag[:, ::every, ::every]]
    planes = PlaneSelection(Range(0, NC))
    totals, exact = histogram.cube_histogram_exact(pixels, CUBE, 20, planes, every)
    assert totals["num_pixels"] == len(some) and (totals["min"], totals["max"], totals["sampled"]) == (some.min(), some.max(), every > 1)
    counts = [r["count"] for r in exact.orderBy("bin").collect()]
    assert counts == np.bincount(Bins(20, float(some.min()), float(some.max())).of(some), minlength=20).tolist()
    for parts in (1, 5):
        one = histogram.cube_histogram_onepass(pixels.repartition(parts), CUBE, 20, planes, every=every).orderBy("bin").collect()
        assert sum(r["count"] for r in one) == one[0].num_pixels == len(some) and (one[0].min, one[0].max) == (some.min(), some.max())
        wide = some.astype(float)
        assert one[0].nan_count == v[:, ::every, ::every].size - len(some) and math.isclose(one[0].sum, wide.sum(), rel_tol=1e-9) and math.isclose(one[0].sum_sq, (wide**2).sum(), rel_tol=1e-9)
        assert math.isclose(one[0].sum_sq_dev, ((wide - wide.mean()) ** 2).sum(), rel_tol=1e-10)
        upto, near = np.cumsum([0, *counts, 0]), np.cumsum([r["count"] for r in one])  # values on an edge may fall to its other side
        assert (upto[:-2] <= near).all() and (near <= upto[2:]).all()
    refused("invalid_argument", selection.sampled, pixels, 0)
    nothing = histogram.cube_histogram_exact(pixels, CUBE, 4, PlaneSelection(Range(3, 1)))
    empty = histogram.cube_histogram_onepass(pixels, CUBE, 4, PlaneSelection(Range(3, 1))).collect()
    assert len(empty) == 4 and all(r["count"] == 0 and math.isnan(r.min) and math.isnan(r.max) and r.num_pixels == 0 and r.nan_count == NX * NY for r in empty)
    assert math.isnan(nothing[0]["min"]) and [r["count"] for r in nothing[1].collect()] == [0] * 4


def test_growing_histogram_keeps_counts():
    rnd = np.random.default_rng(3)
    for scale in (0, 1e-30, 1.0, 1e30):
        v = (rnd.normal(0, 1, 5000) * scale).astype(np.float32)
        whole, parts = histogram.GrowingHistogram(4096), histogram.GrowingHistogram(4096)
        whole.add(v)
        for p in np.array_split(v, 7):
            one = histogram.GrowingHistogram(4096)
            one.add(p)
            if one.width > parts.width and parts.seeded:
                one.merge(parts)
                parts = one
            else:
                parts.merge(one)
        for h in (whole, parts):
            assert h.counts.sum() == 5000 and h.lower <= v.min() and v.max() < h.upper
            out = h.over(16, float(v.min()), float(v.max()))
            assert out.sum() == 5000 and (scale != 0 or out[0] == 5000)
    assert [histogram.provisional_bins(n) for n in (10, 1000, 10**5)] == [4096, 16384, 65536] and histogram.provisional_bins(1, 5) == 8
    assert histogram.auto_bins(64, 25) == 40 and histogram.auto_bins(1, 1) == 2


def test_hyperslab_and_order(pixels):
    v, flag = data()
    ranges = {"x": Range(2, 5, 3), "y": Range(1, 4, 3), "spectral": Range(0, 2, 4), "polarization": Range(0, 1), "time": Range(0, 1)}
    got = [r.value for r in selection.hyperslab(pixels, CUBE, ranges).orderBy("time", "polarization", "channel", "y", "x").collect()]
    want = np.where(flag, np.nan, v)[0:5:4, 1:11:3, 2:15:3].ravel()
    assert selection.elements(ranges) == len(got) and np.array_equal(np.array(got, np.float32), want.astype(np.float32), equal_nan=True)
    refused("invalid_slice", selection.hyperslab, pixels, CUBE, {"x": Range(0, 1)})
    assert selection.first_of_chunks(CUBE, {"x": Range(0, 17)})["x"] == Range(0, 5, 4)
    assert len(selection.spectrum(pixels, CUBE, 3, 3).collect()) == NC and selection.plane(pixels, CUBE, 2).count() == NX * NY


def test_layout_analytics(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0)], "i int, value float")
    b = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 4.0), (3, 0.0)], "i int, value float")
    assert sorted(r.i for r in layouts.differing_pixels(a, b, ["i"]).collect()) == [2, 3]
    assert layouts.fingerprint(a, ["i"]).first() == layouts.fingerprint(a.repartition(3), ["i"]).first() != layouts.fingerprint(b, ["i"]).first()
    rnd = np.random.default_rng(0)
    points = [(i, *map(float, rnd.integers(0, 6, 3))) for i in range(60)]
    best = sorted(i for i, *p in points if not any(all(x <= y for x, y in zip(q, p)) and q != p for _, *q in points))
    frame = spark.createDataFrame(points, "i int, a double, b double, c double")
    assert sorted(r.i for r in layouts.pareto(frame, ["a", "b", "c"]).collect()) == best
    two = sorted(i for i, *p in points if not any(q[0] <= p[0] and q[1] <= p[1] and q[:2] != p[:2] for _, *q in points))
    assert sorted(r.i for r in layouts.pareto(frame, ["a", "b"]).collect()) == two
    frames = spark.createDataFrame([("p", i, t) for i, t in enumerate([9.0, 0.1, 0.3, 0.2, 0.5])], "player string, frame int, took double")
    r = layouts.late_frames(frames, 4.0).first()
    assert (r.frames, r.late_frames, r.frame_first_s, r.frame_median_s, r.frame_max_s) == (5, 2, 9.0, 0.3, 0.5) and math.isclose(r.late_max_s, 0.25)


def test_line_cube_is_the_same_whatever_the_partitioning(spark):
    one, many = line_cube(spark, 150, 140, 3, 7), line_cube(spark.newSession(), 150, 140, 3, 7).repartition(7)
    fp = lambda d: layouts.fingerprint(d, ["channel", "y", "x"]).first()
    assert fp(one) == fp(many) and fp(one) != fp(line_cube(spark, 150, 140, 3, 8)) and one.count() == 150 * 140 * 3
    sky = Sky(7, sources=8, points=3, extended=2, bad_share=0.5)
    got = line_cube(spark, 150, 140, 8, sky=sky)
    flags = {r.channel: (r.some, r.every) for r in got.groupBy("channel").agg(F.bool_or("flagged").alias("some"), F.bool_and("flagged").alias("every")).collect()}
    assert len(sky.bad(8)) == 4 and all(flags[c] == ((c in sky.bad(8)), sky.bad(8).get(c, 0) is None) for c in range(8))
    assert any(dip for *_, dip in sky.lines(150, 140, 8)) and got.filter("channel = 0 and not isnan(value)").count() < 0.85 * 150 * 140
    assert line_cube(spark, 150, 140, 2, sky=Sky(7, fill=None)).filter("isnan(value)").count() == 0


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_front_of_two_costs(spark, slices):
    """Slices of the first cost, ties in both, doubles that are next to each other."""
    rnd = np.random.default_rng(slices)
    points = [(i, float(a) / 3, float(b)) for i, (a, b) in enumerate(rnd.integers(0, 30, (400, 2)))] + [(1000, 0.0, None)]
    best = sorted(i for i, a, b in points if b is not None and not any(c <= a and d <= b and (c, d) != (a, b) for _, c, d in points if d is not None))
    frame = spark.createDataFrame(points, "i int, a double, b double").repartition(4)
    assert sorted(r.i for r in layouts.pareto(frame, ["a", "b"], slices).collect()) == best
