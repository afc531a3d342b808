"""All queries of the engine's own operators, and the SQL that each must equal."""

from __future__ import annotations

import inspect

from . import cube_queries as cube
from . import store_queries as stores
from . import table_queries as tables
from .cube_sql import BIN, BOXES, CHANNELS, HISTOGRAM, PIXELS, RASTER, STATS, histogram_of
from .store_sql import SQL

QUERIES = {n: f for m in (cube, tables, stores) for n, f in inspect.getmembers(m, inspect.isfunction) if f.__module__ == m.__name__ and not n.startswith("_")}

ORACLE_SQL: dict[str, str] = {
    "spectral_reduce": f"WITH {PIXELS}, {BOXES} SELECT region_id, channel AS sel_channel, {STATS} FROM sel GROUP BY ALL",
    "spectral_reduce_masked": f"""WITH {PIXELS}, {RASTER}, {CHANNELS},
        sel AS (SELECT region_id, channel, v FROM px JOIN rs USING (x, y)),
        found AS (SELECT region_id, channel, {STATS} FROM sel GROUP BY ALL)
        SELECT g.region_id, g.channel AS sel_channel, coalesce(num_pixels, 0) AS num_pixels, coalesce(nan_count, 0) AS nan_count, coalesce(sum, 0) AS sum,
            coalesce(sum_sq, 0) AS sum_sq, min, max, coalesce(sum_sq_dev, 0) AS sum_sq_dev
        FROM (SELECT region_id, channel FROM range(3) r(region_id), ch) g LEFT JOIN found USING (region_id, channel)""",
    "spectral_reduce_unmasked_strided": f"""WITH {PIXELS}, {BOXES} SELECT region_id, (channel - 1) // 3 AS sel_channel, count(raw) AS num_pixels, min(raw)::DOUBLE AS min, max(raw)::DOUBLE AS max
        FROM sel WHERE channel BETWEEN 1 AND 16 AND (channel - 1) % 3 = 0 GROUP BY ALL""",
    "spectral_mean_variance": f"""WITH {PIXELS}, {BOXES} SELECT region_id, channel AS sel_channel, round(avg(v::DOUBLE), 6) AS mean, round(var_samp(v::DOUBLE), 6) AS variance FROM sel GROUP BY ALL""",
    "plane_read": f"WITH {PIXELS} SELECT channel, y, x, v::DOUBLE AS value FROM px WHERE channel = 4",
    "spectrum_read": f"WITH {PIXELS} SELECT channel, y, x, v::DOUBLE AS value FROM px WHERE x = 11 AND y = 7",
    "hyperslab_strided": f"""WITH {PIXELS} SELECT channel // 2 AS s_channel, (y - 1) // 3 AS s_y, (x - 3) // 5 AS s_x, v::DOUBLE AS value FROM px
        WHERE x BETWEEN 3 AND 48 AND (x - 3) % 5 = 0 AND y BETWEEN 1 AND 22 AND (y - 1) % 3 = 0 AND channel <= 8 AND channel % 2 = 0""",
    "mask_fold_counts": f"WITH {PIXELS} SELECT channel, count(v) AS kept, count(raw) AS stored, count(*) FILTER (flagged) AS flagged FROM px GROUP BY channel",
    "spatial_sample": f"WITH {PIXELS} SELECT channel, count(*) AS pixels, max(x) AS last_x, max(y) AS last_y FROM px WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY channel",
    "logical_order": f"WITH {PIXELS} SELECT channel * 1600 + y * 64 + x AS place, channel, y, x, raw::DOUBLE AS value FROM px ORDER BY channel, y, x",
    "plane_histogram": HISTOGRAM,
    "plane_histogram_degenerate": f"""WITH {PIXELS}, {CHANNELS}, c AS (SELECT channel, 0 AS bin, count(*) AS n FROM px WHERE v IS NOT NULL AND round(v::DOUBLE, 1) = 0.5 GROUP BY ALL)
        SELECT channel AS sel_channel, bin, coalesce(n, 0) AS count FROM (SELECT channel, bin FROM ch, range(3) b(bin)) LEFT JOIN c USING (channel, bin)""",
    "cube_totals": f"WITH {PIXELS} SELECT {STATS} FROM px",
    "cube_histogram_exact": histogram_of(40),
    "region_runs": f"""WITH {RASTER}, i AS (SELECT region_id, y, x, x - row_number() OVER (PARTITION BY region_id, y ORDER BY x) AS g FROM rs)
        SELECT region_id, y, min(x) AS x_begin, max(x) + 1 AS x_end FROM i GROUP BY region_id, y, g""",
    "region_runs_islands": f"""WITH {PIXELS}, i AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM px WHERE channel = 0 AND raw > 0)
        SELECT 0 AS region_id, y, min(x) AS x_begin, max(x) + 1 AS x_end FROM i GROUP BY y, g""",
    "region_occupancy": f"WITH {RASTER} SELECT DISTINCT region_id, x // 16 AS cx, y // 5 AS cy FROM rs",
    "chunk_region_index": f"WITH {RASTER}, o AS (SELECT DISTINCT region_id, x // 16 AS cx, y // 5 AS cy FROM rs) SELECT cx, cy, string_agg(region_id::VARCHAR, ',' ORDER BY region_id) AS regions FROM o GROUP BY ALL",
    "occupied_footprints": f"WITH {RASTER} SELECT DISTINCT x // 16 AS cx, y // 5 AS cy, 1 AS reads FROM rs",
    "occupied_chunk_semi_join": f"""WITH {PIXELS}, {RASTER} SELECT channel, count(*) AS pixels, min(x) AS x0, max(x) AS x1 FROM px
        WHERE (x // 16, y // 5) IN (SELECT (x // 16, y // 5) FROM rs) GROUP BY channel""",
    "world_coordinate_join": f"WITH {CHANNELS} SELECT channel, 1.4e9 + channel * 1e6 AS frequency, 1.4e9 + channel * 1e6 AS linear FROM ch",
    "grouping_sets": f"""WITH {PIXELS} SELECT y, count(*) AS pixels, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, grouping(y)::INT AS all_rows FROM px WHERE v IS NOT NULL GROUP BY ROLLUP (y)""",
    "value_histogram_lineitem": f"SELECT l_returnflag, {BIN('l_extendedprice::FLOAT', 0.0, 2000.0, 64)} AS bin, count(*) AS count FROM lineitem WHERE l_extendedprice::FLOAT BETWEEN 0 AND 128000 GROUP BY ALL",
    "event_value_histogram": f"SELECT event_type, {BIN('value::FLOAT', 0.0, 10.0, 50)} AS bin, count(*) AS count FROM events WHERE value::FLOAT BETWEEN 0 AND 500 GROUP BY ALL",
    "linear_axis_fit": """WITH s AS (
            SELECT 'even' AS axis, id AS idx, id * 0.25::DOUBLE - 10 AS value FROM range(200) r(id) UNION ALL SELECT 'offset', id, id * 0.5::DOUBLE + 3 FROM range(200) r(id)
            UNION ALL SELECT 'uneven', id, (id * id)::DOUBLE FROM range(200) r(id) UNION ALL SELECT 'equal', id, 7.0::DOUBLE FROM range(200) r(id)
            UNION ALL SELECT 'prices', p_partkey, p_retailprice FROM part),
        w AS (SELECT *, row_number() OVER a AS place, value - lag(value) OVER a AS sp FROM s WINDOW a AS (PARTITION BY axis ORDER BY idx)),
        g AS (SELECT axis, count(*) AS n, max(sp) FILTER (place = 2) AS inc, arg_min(value, place) AS first, arg_max(value, place) AS last, max(abs(value)) AS most,
            arg_min({'p': place, 'v': value}, abs(value) * 1e9 + place * 1e-6) AS near FROM w GROUP BY axis),
        u AS (SELECT axis, coalesce(bool_or(abs(sp - inc) > 1e-9 * greatest(1.0, abs(inc), abs(sp))), false) AS off FROM w JOIN g USING (axis) WHERE place > 2 GROUP BY axis),
        f AS (SELECT *, inc <> 0 AND NOT off AS uniform, CASE WHEN inc <> 0 AND NOT off THEN (last - first) / (n - 1) ELSE inc END AS increment, abs(near.v) <= 1e-12 * greatest(1.0, most) AS exact FROM g JOIN u USING (axis))
        SELECT axis, uniform, round(increment, 6) AS increment, CASE WHEN inc <> 0 THEN 0.0::DOUBLE END AS reference_value,
            CASE WHEN inc <> 0 THEN round(CASE WHEN exact THEN near.p ELSE (0 - first) / increment + 1 END, 6) END AS reference_pixel, inc <> 0 AND off AS nonuniform, inc <> 0 AND NOT exact AS inexact FROM f""",
    "nearest_sample": "SELECT p_brand, p_partkey AS idx, p_retailprice AS value FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1200), p_partkey) = 1",
    "beams_pivot": f"WITH {CHANNELS} SELECT 0 AS time, channel, 0 AS polarization, (2.0 + channel)::DOUBLE AS major, (1.0 + channel / 2.0)::DOUBLE AS minor, (channel * 0.25)::DOUBLE AS pa FROM ch",
    "sweep_medians": """WITH l AS (SELECT user_id % 7 AS setting, event_type AS mode, CASE WHEN event_id % 97 = 0 THEN 'timeout' WHEN event_id % 89 = 0 THEN 'error' ELSE 'ok' END AS status, value + 1.0 AS seconds, event_id, value FROM events),
        t AS (SELECT *, CASE status WHEN 'timeout' THEN 'inf'::DOUBLE WHEN 'ok' THEN seconds END AS time FROM l),
        g AS (SELECT setting, mode, count(*) AS ops, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'timeout') AS timeouts, median(time) AS median_s,
            list_sort(list(time) FILTER (time IS NOT NULL)) AS times, min(time) AS min_s, sum(event_id * 1000) / 1048576 / sum(seconds) FILTER (status = 'ok') AS mib_s, max(event_id + value) - min(event_id) AS makespan_s FROM t GROUP BY ALL)
        SELECT setting, mode, ops, errors, timeouts, CASE WHEN median_s < 'inf' THEN round(median_s, 6) END AS median_s, CASE WHEN times[ceil(len(times) * 0.9)::INT] < 'inf' THEN round(times[ceil(len(times) * 0.9)::INT], 6) END AS p90_s,
            CASE WHEN min_s < 'inf' THEN round(min_s, 6) END AS min_s, round(mib_s, 6) AS mib_s, round(makespan_s, 6) AS makespan_s FROM g""",
    "first_touches": """WITH l AS (SELECT user_id % 7 AS setting, event_type AS mode, event_id, event_id % 5 = 0 AS shares FROM events),
        o AS (SELECT setting, mode, count(*) FILTER (NOT shares) AS n FROM l GROUP BY ALL), e AS (SELECT mode, bool_and(n >= 5) AS enough FROM o GROUP BY mode)
        SELECT mode, count(*) AS kept, sum(event_id)::BIGINT AS ids FROM l JOIN e USING (mode) WHERE NOT enough OR NOT shares GROUP BY mode""",
    "sweep_score": """WITH l AS (SELECT user_id % 7 AS setting, event_type AS mode, median(value + 1.0) AS s FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 GROUP BY ALL),
        b AS (SELECT mode, min(s) AS best FROM l GROUP BY mode), g AS (SELECT setting, exp(sum(length(mode) * ln(s / best)) / sum(length(mode))) AS score, max(s / best) AS worst FROM l JOIN b USING (mode) GROUP BY setting)
        SELECT setting, round(score, 6) AS score, round(worst, 6) AS worst, rank() OVER (ORDER BY score, setting) AS rank FROM g""",
    "sweep_pareto": """SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))""",
    "nearest_rank_p90": """WITH g AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS t FROM orders GROUP BY ALL) SELECT o_orderpriority, t[ceil(len(t) * 0.9)::INT] AS p90, t[len(t) // 2 + 1] AS upper_median FROM g""",
    "checksum_mismatch": "SELECT l_orderkey, l_returnflag, count(DISTINCT l_linestatus) AS kinds FROM lineitem GROUP BY ALL HAVING kinds > 1",
    "first_touch_overlap": """WITH b AS (SELECT o_custkey % 16 AS process, o_orderkey AS op, o_orderkey * 7 % 900 AS x0, o_custkey * 5 % 900 AS y0, o_orderkey % 11 AS z0 FROM orders)
        SELECT a.process, a.op, bool_or(b.op IS NOT NULL) AS shares_chunks FROM b a LEFT JOIN b ON abs(a.x0 - b.x0) < 2 AND abs(a.y0 - b.y0) < 3 AND a.z0 = b.z0 AND (a.process <> b.process OR b.op < a.op) GROUP BY ALL""",
    "late_frames": """WITH f AS (SELECT user_id AS player, value / 100 AS took, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        g AS (SELECT player, count(*) AS frames, count(*) FILTER (i > 1 AND took > 0.2) AS late_frames, greatest(0.0, coalesce(max(took) FILTER (i > 1) - 0.2, 0.0)) AS late_max_s, max(took) FILTER (i = 1) AS frame_first_s,
            list_sort(list(took) FILTER (i > 1)) AS t, max(took) FILTER (i > 1) AS frame_max_s FROM f GROUP BY player)
        SELECT player, frames, late_frames, round(late_max_s, 9)::DOUBLE AS late_max_s, round(frame_first_s, 9) AS frame_first_s, round(t[len(t) // 2 + 1], 9) AS frame_median_s, round(frame_max_s, 9) AS frame_max_s FROM g""",
    "robust_noise_stats": f"""WITH {PIXELS}, p AS (SELECT channel, raw::DOUBLE AS r FROM px WHERE NOT flagged), m AS (SELECT channel, median(r) AS mid, avg((r IS NULL)::INT) AS nan_fraction FROM p GROUP BY ALL),
        d AS (SELECT channel, nan_fraction, abs(r - mid) AS d FROM p JOIN m USING (channel)), s AS (SELECT channel, median(d) * 1.4826 AS rms FROM d GROUP BY ALL)
        SELECT channel, round(nan_fraction, 6) AS nan_fraction, round(rms, 6) AS rms, round(avg((d > 5 * rms)::INT), 6) AS beyond FROM d JOIN s USING (channel) GROUP BY channel, nan_fraction, rms""",
    "noise_summary": f"""WITH {PIXELS}, p AS (SELECT channel, raw::DOUBLE AS r FROM px WHERE NOT flagged), m AS (SELECT channel, median(r) AS mid, avg((r IS NULL)::INT) AS nan_fraction FROM p GROUP BY ALL),
        d AS (SELECT channel, nan_fraction, abs(r - mid) AS d FROM p JOIN m USING (channel)), s AS (SELECT channel, median(d) * 1.4826 AS rms FROM d GROUP BY ALL), f AS (SELECT channel, nan_fraction, rms, avg((d > 5 * rms)::INT) AS beyond FROM d JOIN s USING (channel) GROUP BY ALL)
        SELECT count(*) AS channels, count(*) FILTER (nan_fraction = 1) AS all_nan_channels, round(median(nan_fraction), 6) AS nan_fraction, round(median(rms), 6) AS rms, round(median(beyond), 6) AS beyond FROM f""",
    "nan_chunks": f"WITH {CHANNELS} SELECT count(*) * 20 AS chunks, count(*) FILTER (channel % 7 = 3) * 20 AS all_nan_chunks FROM ch",
    "read_model_fit": """WITH s AS (SELECT sum(l_quantity * l_quantity) AS pp, sum(l_quantity * l_linenumber) AS pc, sum(l_linenumber::DOUBLE * l_linenumber) AS cc, sum(l_quantity * l_extendedprice / 1000) AS ps, sum(l_linenumber * l_extendedprice / 1000) AS cs FROM lineitem)
        SELECT round((pp * cc - pc * pc) / (ps * cc - cs * pc), 6) AS pixels_per_s, round((cs * pp - ps * pc) / (pp * cc - pc * pc), 6) AS seconds_per_chunk FROM s""",
    "pixel_identity": f"WITH {PIXELS} SELECT channel, y, count(*) AS pixels FROM px WHERE channel = 2 AND y = 9 AND raw IS NOT NULL GROUP BY ALL",
    "fingerprint": f"WITH {PIXELS} SELECT count(*) AS pixels, true AS dealt, false AS exchanged, false AS shorter FROM px",
    "cube_histogram_onepass": f"SELECT bin, sum(count) OVER (ORDER BY bin)::BIGINT AS upto, true AS within FROM ({histogram_of(40)})",
    "storage_rules": """SELECT p_partkey, (ceil(512 / (p_size + 1)) * ceil(300 / (p_size + 4)) * (p_size + 1) * (p_size + 4) * 4)::BIGINT AS run_bytes, round(sqrt((p_size + 1) * (p_size + 1) * 256 / (512 * 300)), 9) AS depth FROM part""",
} | SQL
