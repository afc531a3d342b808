"""Pieces of SQL that the catalogues share."""

from __future__ import annotations

#: The cube of ``embeddings`` as SQL: v is the value where good, raw where stored.
PIXELS = """px AS (
    SELECT vec_id // 25 AS channel, vec_id % 25 AS y, x, CASE WHEN (vec_id // 25) % 7 = 3 THEN NULL ELSE e::FLOAT END AS raw,
        (x + vec_id % 25) % 3 = 0 AS flagged, CASE WHEN (vec_id // 25) % 7 = 3 OR (x + vec_id % 25) % 3 = 0 THEN NULL ELSE e::FLOAT END AS v
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS x, unnest(embedding) AS e FROM embeddings))"""
BOXES = """rg AS (SELECT * FROM (VALUES (0, 2, 22, 3, 13), (1, 10, 50, 8, 20)) r(region_id, x0, x1, y0, y1)),
    sel AS (SELECT region_id, channel, raw, v FROM px JOIN rg ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)"""
RASTER = """rs AS (
    SELECT 0 AS region_id, x, y FROM range(10, 31) a(x), range(2, 23) b(y) WHERE (x - 20) * (x - 20) * 100 + (y - 12) * (y - 12) * 100 <= 10000
    UNION ALL SELECT 1, x, y FROM range(30, 60) a(x), range(0, 25) b(y) WHERE (x - 45) * (x - 45) * 36 + (y - 12) * (y - 12) * 225 <= 8100)"""
STATS = """count(v) AS num_pixels, count(*) - count(v) AS nan_count, round(coalesce(sum(v::DOUBLE), 0), 6) AS sum,
    round(coalesce(sum(v::DOUBLE * v::DOUBLE), 0), 6) AS sum_sq, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max,
    round(coalesce(var_pop(v::DOUBLE) * count(v), 0), 6) AS sum_sq_dev"""
BIN = lambda v, lo, w, n: f"least(floor(({v} - {lo}::FLOAT)::FLOAT / {w}::FLOAT)::INT, {n - 1})"
CHANNELS = "ch AS (SELECT DISTINCT vec_id // 25 AS channel FROM embeddings)"
#: Counts of 50 bins from -1 to 1 by channel.
HISTOGRAM = f"""WITH {PIXELS}, {CHANNELS}, c AS (SELECT channel, {BIN("v", -1.0, 0.04, 50)} AS bin, count(*) AS n FROM px WHERE v BETWEEN -1 AND 1 GROUP BY ALL)
    SELECT channel AS sel_channel, bin, coalesce(n, 0) AS count FROM (SELECT channel, bin FROM ch, range(50) b(bin)) LEFT JOIN c USING (channel, bin)"""


def histogram_of(bins: int) -> str:
    """Counts of all good pixels over their own range."""
    return f"""WITH {PIXELS}, r AS (SELECT min(v) AS lo, max(v) AS hi, ((max(v)::DOUBLE - min(v)::DOUBLE) / {bins})::FLOAT AS w FROM px),
        c AS (SELECT least(floor((v - lo)::FLOAT / w)::INT, {bins - 1}) AS bin, count(*) AS n FROM px, r WHERE v IS NOT NULL GROUP BY ALL)
        SELECT bin, coalesce(n, 0) AS count FROM range({bins}) b(bin) LEFT JOIN c USING (bin)"""
