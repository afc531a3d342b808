"""Blocks, prefixes, streams, stopping and reading ahead."""

import threading
import time

import pytest
from pyspark.sql import functions as F
from test_sources import refused

from cubespark.functions.pixels import Bins
from cubespark.model import PlaneSelection, Range, Region, Statistic
from cubespark.operators import reduce, regions, selection
from cubespark.sources.synthetic import cube_of, formula
from cubespark.streaming import progress, readahead

CUBE = cube_of(8, 6, 10, chunk={"x": 4, "y": 3, "spectral": 2})


@pytest.fixture(scope="module")
def pixels(spark):
    return formula(spark, CUBE, lambda x, y, c, p, t: x + y * 10 + c * 100, lambda x, y, c, p, t: x == 1).persist()


def test_pieces_are_a_prefix(pixels):
    seen, got = [], []
    for rows in progress.read_in_pieces(pixels, CUBE, selection.whole(CUBE), lambda a, b: seen.append((a, b)) or True):
        got += rows.to_pylist()
    assert [(r["channel"], r["y"], r["x"]) for r in got] == [(c, y, x) for c in range(10) for y in range(6) for x in range(8)] and seen[-1] == (480, 480)
    with pytest.raises(Exception, match="cancelled"):
        list(progress.read_in_pieces(pixels, CUBE, selection.whole(CUBE), lambda a, b: False))


def test_planned_pieces():
    """Pieces tile the selection in logical order, hold few chunks, keep planes whole unless one alone is too large."""
    deep = cube_of(8, 6, 10, 2, 3, chunk={"x": 4, "y": 3, "spectral": 2})
    place = lambda p: [(t, s, c, y, x) for t in p["time"].indices() for s in p["polarization"].indices() for c in p["spectral"].indices() for y in p["y"].indices() for x in p["x"].indices()]
    for ranges, how, many in (
        (selection.whole(deep), {}, 3 * 2 * 2),
        (selection.whole(deep), {"most": 100}, 1),  # the times are one chunk
        (selection.whole(deep), {"most": 1}, 3 * 2 * 5),
        (selection.whole(deep, time=Range(1, 1), spectral=Range(1, 3, 3), x=Range(0, 2)), {"most": 4}, 2 * 2),
        (selection.whole(CUBE), {"most": 2, "budget": 100}, 10 * 2),
    ):
        cube = CUBE if ranges["time"].count == 1 and ranges["spectral"].stride == 1 else deep
        parts = progress.plan_pieces(cube, ranges, **how)
        assert len(parts) == many and [at for p in parts for at in place(p)] == place(ranges)


def test_blocks_tile_the_selection(spark, pixels):
    frame = regions.region_table(spark, [Region(0, 0, 0, 8, 6), Region(1, 2, 2, 3, 3)], CUBE)
    planes = PlaneSelection(Range(1, 4, 2))
    runs, ids = regions.runs_of(frame), frame.select("region_id")
    whole = {tuple(r) for r in reduce.spectral_reduce(pixels, CUBE, runs, ids, planes, Statistic.sum | Statistic.max).collect()}
    got, shares = set(), []
    for _, block, share in progress.reduce_in_blocks(pixels, CUBE, runs, ids, planes, Statistic.sum | Statistic.max, emit_every=3):
        got |= {tuple(r) for r in block.collect()}
        shares.append(share)
    assert got == whole and len(whole) == 8 and shares[-1] == 1 and shares == sorted(shares)
    assert progress.cuts(10, 4, 9) == [(0, 8), (8, 10)] and progress.cuts(5, 4, 2) == [(0, 2), (2, 4), (4, 5)]


def test_streamed_statistics_and_snapshots(spark, pixels, tmp_path):
    for c in (0, 1):
        for half in (0, 1):
            pixels.filter((F.col("channel") == c) & (F.col("y") % 2 == half)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, seen, snaps = progress.pixel_stream(spark, str(tmp_path / "in")), {}, []
    progress.stream_blocks(stream, 48, lambda b, n: seen.setdefault(n, b.collect()), str(tmp_path / "c1")).awaitTermination()
    finals = {r.channel: r for rows in seen.values() for r in rows if r.complete}
    assert len(seen) == 4 and set(finals) == {0, 1} and all(0 < r.completeness <= 1 for rows in seen.values() for r in rows)
    want = {r.channel: r for r in progress.running_statistics(pixels).collect()}
    assert all((f.num_pixels, f.sum, f.min, f.max) == (want[c].num_pixels, want[c].sum, want[c].min, want[c].max) for c, f in finals.items())
    progress.histogram_snapshots(progress.pixel_stream(spark, str(tmp_path / "in")), Bins(10, 0.0, 200.0), lambda b, n: snaps.append(sum(r["count"] for r in b.collect())), str(tmp_path / "c2")).awaitTermination()
    assert snaps == sorted(snaps) and snaps[-1] == 2 * 42


def test_streamed_regions(spark, pixels, tmp_path):
    """Updates by region and channel grow to the result of one pass; snapshots of the growing histogram are full results."""
    some = [Region(0, 0, 0, 8, 6), Region(1, 2, 2, 3, 3, bytes([1, 0, 1, 0, 1, 0, 0, 0, 1]))]
    frame = regions.region_table(spark, some, CUBE)
    for part in range(3):
        pixels.filter((F.col("x") + F.col("y") + F.col("channel")) % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, found = [], []
    stream = progress.pixel_stream(spark, str(tmp_path / "in"))
    progress.stream_region_blocks(stream, regions.runs_of(frame), lambda b, n: seen.append(b.collect()), str(tmp_path / "c1")).awaitTermination()
    assert len(seen) == 3 and all(0 < r.completeness <= 1 and r.complete == (r.completeness == 1) for rows in seen for r in rows)
    final = {(r.region_id, r.channel): r for rows in seen for r in rows if r.complete}
    want = reduce.spectral_reduce(pixels, CUBE, regions.runs_of(frame), frame.select("region_id"), PlaneSelection(Range(0, 10))).collect()
    assert len(final) == len(want) == 20
    for r in want:
        f = final[r.region_id, r.sel_channel]
        assert all(abs(f[s.name] - r[s.name]) < 1e-6 * max(1, abs(r[s.name])) for s in Statistic)
    progress.growing_snapshots(progress.pixel_stream(spark, str(tmp_path / "in")), 12, lambda h, n: found.append((h.totals(), h.counts(12))), str(tmp_path / "c2")).awaitTermination()
    assert [int(c.sum()) for _, c in found] == [int(t["num_pixels"]) for t, _ in found] and found[-1][0]["num_pixels"] == 420 and found[-1][0]["nan_count"] == 60
    assert (found[-1][0]["min"], found[-1][0]["max"]) == (0.0, 957.0) and len(list((tmp_path / "c2" / "histogram").iterdir())) == 3


def test_stopping(spark):
    slow = spark.range(8).repartition(8).mapInPandas(lambda it: (time.sleep(1) or p for p in it), "id bigint")

    def run(**how):
        with progress.stoppable(spark, **how):
            for _ in range(20):
                slow.count()

    refused("cancelled", run, deadline_s=0.5)
    refused("cancelled", run, cancelled=lambda: True)
    with progress.stoppable(spark, deadline_s=60):
        assert spark.range(3).count() == 3


def at(channel):
    return selection.whole(CUBE, spectral=Range(channel, 1))


class Gate:
    def __init__(self):
        self.asked, self.open = [], threading.Event()

    def __call__(self, read):
        self.asked.append(read["spectral"].start)
        self.open.wait(5)


def test_read_ahead(spark, pixels):
    now, gate = [0.0], Gate()
    ahead = readahead.ReadAhead([readahead.Source("a", CUBE, gate)], clock=lambda: now[0])
    coming = lambda c: [[(0, at(k))] for k in range(c + 1, 10)]
    ahead.served(1.0, False, [(0, at(0))], coming(0))
    assert ahead.stats().under_way and ahead.stats().prefetches == 1
    now[0] = 2.0
    ahead.served(2.0, False, [(0, at(2))], coming(2))  # the run that is being fetched
    assert ahead.stats().caught_up == 1 and ahead.stats().prefetches == 1
    gate.open.set()
    ahead.join()
    now[0] = 3.0
    ahead.served(3.0, False, [(0, at(1))], coming(1))  # its next run was asked for last: not again
    assert gate.asked == [2]
    ahead.served(4.0, True, [(0, at(2))], coming(2))  # late, but nothing ran beside it
    ahead.join()
    assert gate.asked == [2, 4] and not ahead.stats().stopped
    gate.open.clear()
    ahead.served(5.0, False, [(0, at(4))], coming(4))
    now[0] = 6.0
    ahead.served(6.0, True, [(0, at(5))], coming(5))
    assert ahead.stats().stopped
    gate.open.set()
    ahead.join()
    ahead.cancel()
    ahead.served(9.0, False, [(0, at(6))], coming(6))
    assert gate.asked == [2, 4, 6]


def test_read_ahead_refusals(pixels):
    refused("invalid_argument", readahead.ReadAhead, [])
    refused("invalid_argument", readahead.ReadAhead, [readahead.Source("a", CUBE, print, run_bytes=0)])
    refused("buffer_too_small", readahead.ReadAhead, [readahead.Source(n, CUBE, print, "c", 300, 100) for n in "ab"])
    readahead.ReadAhead([readahead.Source(n, CUBE, print, "c", 400, 100) for n in "ab"])
    assert readahead.plane_run_bytes(CUBE) == 8 * 6 * 2 * 4 and readahead.run_request(CUBE, readahead.run_of(CUBE, at(3)))["spectral"] == Range(2, 2)
    kept, chunks = readahead.prefetch(pixels, CUBE, at(3))
    assert kept.is_cached and kept.count() == 48 and chunks == 4
    kept.unpersist()


def test_cache_pool(pixels):
    """Reads are kept up to the limit, the one unused for longest goes, and a pool of 0 keeps nothing."""
    pool, made = readahead.CachePool(2 * 48 * 4), []

    def read(c):
        found = readahead.prefetch(pixels, CUBE, at(c), pool)[0]
        made.append(found)
        return found

    a, b = read(0), read(1)
    assert read(0) is a and pool.held == 384
    read(2)
    assert a.is_cached and not b.is_cached and read(1) is not b and not a.is_cached
    pool.clear()
    assert pool.held == 0 and not any(f.is_cached for f in made)
    nothing = readahead.CachePool(0)
    assert not readahead.prefetch(pixels, CUBE, at(0), nothing)[0].is_cached and nothing.held == 0
    refused("invalid_argument", readahead.CachePool, -1)


def test_failing_fetch_stops():
    def broken(read):
        raise MemoryError

    ahead = readahead.ReadAhead([readahead.Source("a", CUBE, broken)])
    ahead.served(0.0, False, [(0, at(0))], [[(0, at(2))]])
    ahead.join()
    assert ahead.stats().stopped
