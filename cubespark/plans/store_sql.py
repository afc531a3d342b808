"""The SQL that each query of ``store_queries`` must equal: on the tables themselves, never on what was written."""

from __future__ import annotations

from .cube_sql import BOXES, CHANNELS, HISTOGRAM, PIXELS, RASTER, STATS, histogram_of

C = "n AS (SELECT max(vec_id) // 25 + 1 AS c FROM embeddings)"
_EACH = "ch AS (SELECT DISTINCT vec_id // 25 AS channel FROM embeddings)"
_DIMS = "'time,frequency,polarization,l,m'"
_TOLD = f"SELECT {STATS}, {{sampled}} AS sampled, count(v) AS counted, {{bins}} AS bins FROM px"


def _rows(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) r({names})"


_REFUSED = {
    "unsupported_transport": ("scheme",),
    "not_found": ("missing",),
    "not_zarr": ("file", "no document"),
    "unsupported_zarr_version": ("old format",),
    "invalid_metadata": ("bad json", "root array", "name up", "name root", "name empty", "name back", "negative shape", "names twice", "names few", "grid", "type", "transpose", "inner rank", "keys"),
    "invalid_slice": ("count 0", "stride 0", "outside", "axes", "product", "polarization", "region empty", "region outside"),
    "not_implemented": ("no spectral", "unknown axis"),
    "invalid_argument": ("sample 0", "raster", "no regions", "incidences", "bins 0", "bounds", "bounds wide", "no statistic", "nothing ahead", "mode"),
    "buffer_too_small": ("small cache",),
    "unsupported_schema": ("schema",),
    None: ("name good", "document", "inside"),
}

SQL: dict[str, str] = {
    "zarr_plane": f"WITH {PIXELS} SELECT channel, y, x, v::DOUBLE AS value FROM px WHERE channel = 4",
    "zarr_spectrum": f"WITH {PIXELS} SELECT channel, y, x, v::DOUBLE AS value FROM px WHERE x = 11 AND y = 7",
    "zarr_hyperslab": f"""WITH {PIXELS} SELECT channel // 2 AS s_channel, (y - 1) // 3 AS s_y, (x - 3) // 5 AS s_x, v::DOUBLE AS value FROM px
        WHERE x BETWEEN 3 AND 48 AND (x - 3) % 5 = 0 AND y BETWEEN 1 AND 22 AND (y - 1) % 3 = 0 AND channel <= 8 AND channel % 2 = 0""",
    "zarr_logical_order": f"WITH {PIXELS} SELECT channel * 1600 + y * 64 + x AS place, channel, y, x, raw::DOUBLE AS value FROM px",
    "zarr_region_stats": f"WITH {PIXELS}, {BOXES} SELECT region_id, channel AS sel_channel, {STATS} FROM sel GROUP BY ALL",
    "zarr_region_stats_masked": f"""WITH {PIXELS}, {RASTER}, {CHANNELS}, sel AS (SELECT region_id, channel, v FROM px JOIN rs USING (x, y)), found AS (SELECT region_id, channel, {STATS} FROM sel GROUP BY ALL)
        SELECT g.region_id, g.channel AS sel_channel, coalesce(num_pixels, 0) AS num_pixels, coalesce(nan_count, 0) AS nan_count, coalesce(sum, 0) AS sum, coalesce(sum_sq, 0) AS sum_sq, min, max, coalesce(sum_sq_dev, 0) AS sum_sq_dev
        FROM (SELECT region_id, channel FROM range(3) r(region_id), ch) g LEFT JOIN found USING (region_id, channel)""",
    "zarr_blocks": f"""WITH {PIXELS}, {BOXES} SELECT region_id, channel, count(*) - count(v) AS nan_count, max(v)::DOUBLE AS max, 0.0::DOUBLE AS sum, true AS no_min, true AS carries_max, false AS carries_sum FROM sel GROUP BY ALL""",
    "zarr_plane_histogram": HISTOGRAM,
    "zarr_histogram": histogram_of(40),
    "cube_histogram_onepass_totals": f"WITH {PIXELS} {_TOLD.format(sampled='false', bins=40)}",
    "zarr_histogram_sampled": f"WITH {PIXELS} {_TOLD.format(sampled='true', bins=25)} WHERE x % 4 = 0 AND y % 4 = 0",
    "zarr_nodes": f"""WITH {C} SELECT 'SKY' AS name, 'array' AS kind, {_DIMS} AS dims, '1,' || c || ',1,64,25' AS shape, 'float32' AS data_type, '1,1,1,16,5' AS chunk, '1,1,1,32,25' AS shard, 'zstd' AS compressor FROM n
        UNION ALL SELECT 'BAD', 'array', {_DIMS}, '1,' || c || ',1,64,25', 'bool', '1,2,1,64,25', NULL, 'zstd' FROM n
        UNION ALL SELECT 'BEAM_FIT_PARAMS_SKY', 'array', 'time,frequency,polarization,beam_params_label', '1,' || c || ',1,3', 'float64', '1,3,1,2', NULL, 'zstd' FROM n
        UNION ALL SELECT 'beam_params_label', 'array', 'beam_params_label', '3', 'fixed_length_utf32', '2', NULL, 'zstd' UNION ALL SELECT 'frequency', 'array', 'frequency', c::VARCHAR, 'float64', '7', NULL, 'zstd' FROM n
        UNION ALL SELECT 'l', 'array', 'l', '64', 'float64', '64', NULL, 'zstd' UNION ALL SELECT 'm', 'array', 'm', '25', 'float64', '25', NULL, 'zstd'
        UNION ALL SELECT 'polarization', 'array', 'polarization', '1', 'fixed_length_utf32', '1', NULL, 'zstd' UNION ALL SELECT 'time', 'array', 'time', '1', 'float64', '1', NULL, 'zstd'""",
    "zarr_size": f"WITH {C} SELECT (c * 1600 * 4 + c * 1600 + c * 24 + 60 + c * 8 + 512 + 200 + 4 + 8)::BIGINT AS declared_bytes, 'declared' AS untimed, 'measured' AS timed, true AS measured FROM n",
    "zarr_coordinates": f"""WITH {C} SELECT 'l' AS axis, 'x' AS role, 3 AS stored, i AS idx, round((i - 32) * -1e-5, 9) + 0.0 AS value, NULL AS label FROM range(64) r(i) UNION ALL SELECT 'm', 'y', 4, i, round((i - 12) * 1e-5, 9) + 0.0, NULL FROM range(25) r(i)
        UNION ALL SELECT 'frequency', 'spectral', 1, channel, 1.4e9 + channel * 1e6, NULL FROM (SELECT DISTINCT vec_id // 25 AS channel FROM embeddings) UNION ALL SELECT 'polarization', 'polarization', 2, 0, NULL, 'I' UNION ALL SELECT 'time', 'time', 0, 0, 1.7e9, NULL""",
    "zarr_axes": """SELECT 'l' AS axis, true AS uniform, round(degrees(-1e-5), 9) AS increment, 0.0::DOUBLE AS reference_value, 33.0::DOUBLE AS reference_pixel, '' AS notes
        UNION ALL SELECT 'm', true, round(degrees(1e-5), 9), 0.0, 13.0, '' UNION ALL SELECT 'frequency', true, 1e6, 1.4e9, 1.0, ''""",
    "zarr_image": """SELECT 'sky' AS type, 'Jy/beam' AS unit, 'BAD' AS flag, 'base' AS data_groups, 'y' AS fastest, 'zstd' AS compressor, 'SIN' AS projection, 'ICRS' AS frame, 2000.0::DOUBLE AS equinox, round(degrees(1.25), 6) AS ra, round(degrees(-0.5), 6) AS dec,
        0.0::DOUBLE AS pole_ra, round(degrees(1.5), 6) AS pole_dec, 1 AS parameters, 'Field 7' AS object, 'Dish' AS telescope, round(6371000 * cos(-0.4) * cos(2.0), 6) AS px, round(6371000 * cos(-0.4) * sin(2.0), 6) AS py, round(6371000 * sin(-0.4), 6) AS pz,
        round(40587 + 1.7e9 / 86400, 6) AS mjd, round(degrees(1.25), 6) AS pointing_ra, round(degrees(-0.5), 6) AS pointing_dec, 'LSRK' AS spectral_frame, 1.420405751e9::DOUBLE AS rest_frequency, 'UTC' AS time_scale, 'UNIX' AS time_format,
        '{"note": "image''s", "run": 4, "site": "here"}' AS keywords, 'keyword big is left out,keyword deep is left out' AS left_out""",
    "zarr_beams": f"WITH {_EACH} SELECT 0 AS time, channel, 0 AS polarization, (2.0 + channel)::DOUBLE AS major, (1.0 + channel / 2.0)::DOUBLE AS minor, (channel * 0.25)::DOUBLE AS pa FROM ch",
    "zarr_elements": f"WITH {_EACH} SELECT channel, label, CASE label WHEN 'Minor' THEN 1.0 + channel / 2.0 WHEN 'PA' THEN channel * 0.25 ELSE 2.0 + channel END::DOUBLE AS value FROM ch, (VALUES ('Minor'), ('PA'), ('major')) l(label)",
    "zarr_scan_plan": f"""WITH {C}, t AS (SELECT c, (c + 2) // 3 AS t FROM n)
        SELECT selection, files, files::INT AS tasks_of_one, 1 AS tasks, elements, chunks, 4000 AS file_bytes, last_box FROM t, LATERAL (
            SELECT 'whole' AS selection, 2 * c AS files, 1600 * c AS elements, 20 * c AS chunks, '0,' || (c - 1) || ',0,32,0,1,' || c || ',1,64,25' AS last_box
            UNION ALL SELECT 'plane', 2, 1600, 20, '0,4,0,32,0,1,5,1,64,25' UNION ALL SELECT 'spectrum', c, c, c, '0,' || (c - 1) || ',0,40,3,1,' || c || ',1,41,4'
            UNION ALL SELECT 'third channels', 2 * t, 1600 * t, 20 * t, '0,' || (3 * t - 3) || ',0,32,0,1,' || (3 * t - 2) || ',1,64,25' UNION ALL SELECT 'one cell', c, 1600 * c, 20 * c, '0,' || (c - 1) || ',0,32,0,1,' || c || ',1,64,25')""",
    "zarr_spatial_sample": f"WITH {PIXELS} SELECT channel, count(*) AS pixels, max(x) AS last_x, max(y) AS last_y FROM px WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY channel",
    "zarr_world": f"WITH {PIXELS} SELECT channel, count(*) AS pixels, 1.4e9 + channel * 1e6 AS low, 1.4e9 + channel * 1e6 AS high FROM px GROUP BY channel",
    "zarr_rewritten": f"""WITH {PIXELS} SELECT channel - 1 AS channel, count(*) AS pixels, count(v) AS good, round(coalesce(sum(v::DOUBLE), 0), 6) AS sum, 1.4e9 + channel * 1e6 AS frequency FROM px
        WHERE x BETWEEN 8 AND 47 AND y BETWEEN 2 AND 21 AND channel BETWEEN 1 AND 9 GROUP BY px.channel""",
    "zarr_rounded": f"WITH {PIXELS} SELECT channel, count(*) AS pixels, 0 AS too_far, 0 AS nan_moved FROM px GROUP BY channel",
    "zarr_raw_sink": f"""WITH {PIXELS} SELECT count(*) AS n, count(*) - count(raw) AS nan_values, round(sum(raw::DOUBLE), 4) AS sum, round(sum(raw::DOUBLE * raw::DOUBLE), 4) AS sum_sq,
        max(raw::DOUBLE) FILTER (channel = 0 AND y = 0 AND x = 0) AS first_value, max(raw::DOUBLE) FILTER (channel = 0 AND y = 1 AND x = 0) AS next_row FROM px""",
    "zarr_fits_sink": f"WITH {PIXELS}, {C} SELECT channel, y, x, v::DOUBLE AS value, 'RA---SIN 64 33|DEC--SIN 25 13|FREQ ' || c || ' 1|STOKES 1 1' AS axes, 0 AS past_block FROM px, n",
    "zarr_sql_text": f"WITH {PIXELS}, {RASTER} SELECT channel, count(*) AS pixels, round(coalesce(sum(v::DOUBLE), 0), 6) AS sum FROM px JOIN rs USING (x, y) WHERE region_id = 1 GROUP BY channel",
    "zarr_pieces": f"WITH {C} SELECT p AS piece, 16 * p AS low, least(16 * p + 15, c - 1) AS high, (least(16 * p + 16, c) - 16 * p) * 1600 AS pixels, true AS prefix, least(16 * p + 16, c) * 1600 AS done, c * 1600 AS total FROM n, range(1000000) r(p) WHERE 16 * p < c",
    "zarr_plane_runs": f"WITH {C}, {_EACH} SELECT channel, channel // 4 AS run, channel // 4 * 4 AS low, least(4, c - channel // 4 * 4) AS channels, 64 AS width, 25600 AS bytes, 32000 AS flagged_bytes FROM ch, n",
    "stream_region_statistics": f"WITH {PIXELS}, {BOXES} SELECT region_id, channel, {STATS}, true AS whole FROM sel GROUP BY ALL",
    "stream_histogram": f"WITH {PIXELS} SELECT {STATS}, count(v) AS counted, 3 AS snapshots, true AS rising FROM px",
    "qualify_nodes": _rows(
        """('SKY', true, true, false, NULL), ('SKY_MODEL', true, true, false, NULL), ('OTHER', true, true, false, NULL), ('WRONG_SIZE', true, false, true, 'invalid_metadata'), ('FLAT', true, false, true, 'invalid_metadata'),
        ('DEEP', true, false, true, 'invalid_metadata'), ('COMPLEX', true, false, false, 'unsupported_data_type'), ('BOOLS', true, false, false, 'unsupported_data_type'), ('GRID', true, false, true, 'invalid_metadata'),
        ('BADFLAG', true, false, true, 'invalid_metadata'), ('NAMED', true, false, true, 'invalid_metadata'), ('BROKEN', false, false, true, 'unreadable_array'), ('ODD', false, false, true, 'unrecognized_node')""",
        "name, listed, openable, malformed, code",
    ),
    "listing_rank": """WITH i AS (SELECT * FROM (VALUES ('SKY', true, 0, 'base', 1), ('SKY_MODEL', true, 1, 'again', 2), ('OTHER', true, 1, 'late', 8), ('NAMED', false, 1, 'late', 8), ('WRONG_SIZE', false, 2, '', 8),
        ('FLAT', false, 2, '', 8), ('DEEP', false, 2, '', 8), ('COMPLEX', false, 2, '', 8), ('BOOLS', false, 2, '', 8), ('GRID', false, 2, '', 8), ('BADFLAG', false, 2, '', 8)) v(name, openable, later, grp, known)),
        r AS (SELECT *, row_number() OVER (ORDER BY later, grp, known, name) AS rank FROM i)
        SELECT name, openable, rank, rank = (SELECT min(rank) FROM r WHERE openable) AS is_default FROM r""",
    "probe_kinds": _rows(
        """('good', 'supported', 'xradio.image', NULL, NULL), ('no version', 'invalid', 'xradio.image', 'unsupported_schema_version', 'unsupported_schema_version'), ('other version', 'invalid', 'xradio.image', 'unsupported_schema_version', 'unsupported_schema_version'),
        ('no groups', 'invalid', 'xradio.image', 'invalid_metadata', 'invalid_schema'), ('no system', 'invalid', 'xradio.image', 'invalid_metadata', 'invalid_schema'), ('bare', 'zarr_without_supported_schema', NULL, NULL, 'unsupported_schema'),
        ('two schemas', 'invalid', NULL, 'ambiguous_schema', NULL)""",
        "store, kind, schema_id, why, refused",
    ),
    "refusals": _rows(", ".join(f"('{case}', {'NULL' if code is None else repr(code)})" for code, cases in _REFUSED.items() for case in cases), 'what, code'),
    "results_summary": """WITH e AS (SELECT event_type AS mode, round(value, 3) AS seconds, event_id % 5 = 0 AS shares, event_id % 89 = 0 AS failed, event_id % 4 AS late, round(value / 8, 3) AS frame FROM events),
        f AS (SELECT *, CASE WHEN NOT shares AND NOT failed THEN seconds END AS first FROM e), g AS (SELECT mode, count(first) AS first_touches, median(first) AS median_s, list_sort(list(first) FILTER (first IS NOT NULL)) AS t, sum(late) / (count(*) * 8) AS late_share, median(frame) AS frame FROM f GROUP BY mode)
        SELECT mode, first_touches, round(median_s, 6) AS median_s, round(t[ceil(len(t) * 0.9)::INT], 6) AS p90_s, round(late_share, 6) AS late_share, round(frame, 6) AS frame_median_s FROM g""",
    "formula_cube": """SELECT c AS channel, p AS polarization, count(*) AS pixels, count(*) FILTER ((x + c) % 4 = 0) AS flagged, sum(x + y * 10 + c * 100 + p * 0.5)::DOUBLE AS sum
        FROM range(9) a(x), range(7) b(y), range(40) d(c), range(2) e(p) GROUP BY ALL""",
    "line_cube": """WITH g AS (SELECT 2 * (x + 0.5) / 200 - 1 AS u, 2 * (y + 0.5) / 150 - 1 AS v FROM range(200) a(x), range(150) b(y)), o AS (SELECT count(*) AS pixels, count(*) FILTER (u * u * u * u + v * v * v * v > pow(0.8 / (gamma(1.25) * gamma(1.25) / gamma(1.5)), 2)) AS outside FROM g)
        SELECT channel, pixels, outside, true AS as_planned FROM o, range(24) c(channel)""",
    "sky_deprojection": """WITH p AS (SELECT p_partkey, (p_partkey % 101 - 50) * 0.012::DOUBLE AS l, (p_size - 25) * 0.02::DOUBLE AS m FROM part), n AS (SELECT *, sqrt(greatest(0.0, 1 - l * l - m * m)) AS n FROM p)
        SELECT p_partkey, round(1.25 + atan2(l, n * cos(-0.5) - m * sin(-0.5)), 9) AS longitude, round(asin(m * cos(-0.5) + n * sin(-0.5)), 9) AS latitude FROM n""",
    "split_mix_words": """WITH m AS (SELECT * FROM (VALUES ('plane', 0), ('spectrum', 1), ('region', 2), ('cube_histogram', 3), ('open', 4), ('animation', 5)) v(mode, k)), k AS (SELECT 18446744073709551616::UHUGEINT AS w, 11400714819323198485::UHUGEINT AS g),
        s AS (SELECT mode, n, w, (7 * g + k::UHUGEINT * 281474976710656 + 131072 + 1 + (n + 1)::UHUGEINT * g) % w AS z FROM m, k, range(16) r(n)),
        a AS (SELECT mode, n, w, xor(z, z >> 30) * 13787848793156543929::UHUGEINT % w AS z FROM s), b AS (SELECT mode, n, w, xor(z, z >> 27) * 10723151780598845931::UHUGEINT % w AS z FROM a), f AS (SELECT mode, n, w, xor(z, z >> 31) AS z FROM b)
        SELECT mode, n, lower(lpad(to_hex(z::UBIGINT), 16, '0')) AS word, (z * 1000 // w)::BIGINT AS scaled FROM f""",
    "planned_positions": f"WITH {C} SELECT mode, 12 AS ops, least(12, CASE mode WHEN 'plane' THEN c ELSE 12 END) AS unlike, 0 AS overlap, true AS inside, CASE mode WHEN 'plane' THEN 1600 WHEN 'spectrum' THEN c ELSE 84 * c END AS pixels FROM n, (VALUES ('plane'), ('spectrum'), ('region')) v(mode)",
}
