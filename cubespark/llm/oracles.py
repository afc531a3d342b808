"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licences, merkle


WARC = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
    """

REPEATS = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
    hit AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(range(35)) AS o FROM hit)),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical(column: str, notices: bool = False) -> str:
    """licences.canonical as SQL."""
    newline = "chr(10)"
    found = f"translate({column}, '{licences.UPPER}', '{licences.LOWER}')"
    if not notices:
        found = f"regexp_replace({found}, {_quoted(licences.NOTICE)}, {newline}, 'g')"
    for a, b in licences.SPELLINGS:
        found = f"replace({found}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(regexp_replace({found}, {_quoted(licences.SIGNS)}, ' ', 'g'))"


def licence_sql() -> str:
    rows = lambda some: ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in some)
    speaks = " OR ".join(f"contains(translate(line, '{licences.UPPER}', '{licences.LOWER}'), {_quoted(x)})" for x in licences.SPEAKS)
    return f"""
    WITH known AS (
        SELECT 'text' AS kind, license, sha256({_canonical("text")}) AS digest FROM (VALUES {rows(licences.TEXTS)}) v(license, text)
        UNION SELECT 'text', license, digest FROM (VALUES {rows(licences.DIGESTS)}) v(license, digest)
        UNION SELECT 'line', license, sha256({_canonical("text", True)}) FROM (VALUES {rows(licences.LINES)}) v(license, text)),
    whole AS (SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS canonical_sha256 FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    declared AS (
        SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS declared
        FROM (SELECT doc_id, sha256({_canonical("line", True)}) AS digest FROM lines WHERE {speaks}) JOIN known USING (digest)
        WHERE kind = 'line' GROUP BY doc_id)
    SELECT doc_id, canonical_sha256, k.license AS license_id, declared
    FROM whole LEFT JOIN (SELECT digest, max(license) AS license FROM known WHERE kind = 'text' GROUP BY digest) k ON k.digest = canonical_sha256
    LEFT JOIN declared USING (doc_id)
    """


def merkle_sql() -> str:
    tree = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,{merkle.SPAN}}}'), lambda b: md5(b))))"
    join = lambda x: f"coalesce(array_to_string({x}, ''), '')"
    paragraphs = lambda t: f"list_transform({t}, lambda s: list_transform(s, lambda p: md5({join('p')})))"
    root = lambda p: f"md5({join(f'list_transform({p}, lambda s: md5({join("s")}))')})"
    leaves = lambda t: f"list_transform(flatten(flatten({t})), lambda x: x[1:{merkle.CUT}])"
    like = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"
    most = lambda a, b: f"greatest(coalesce(len({a}), 0), coalesce(len({b}), 0))"
    differ = f"flatten(list_transform(range({most('p', 'q')}), lambda i: list_transform(list_filter(range({most('p[i + 1]', 'q[i + 1]')}), lambda j: p[i + 1][j + 1] IS DISTINCT FROM q[i + 1][j + 1]), lambda j: i || '/' || j)))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
    e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited FROM n),
    t AS (SELECT doc_id, n_chars, edited, {tree("text")} AS a, {tree("edited")} AS b, {tree("next_text")} AS c FROM e),
    o AS (SELECT *, {paragraphs("a")} AS p, {paragraphs("b")} AS q, {leaves("a")} AS f, {leaves("b")} AS g, {leaves("c")} AS h FROM t),
    l AS (SELECT *, list_distinct(f) AS x, list_distinct(g) AS y, list_distinct(h) AS z, {differ} AS differing FROM o)
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {root("p")} || ':' || {join("f")} AS fingerprint,
        {root("q")} || ':' || {join("g")} AS edited_fingerprint, round({like("x", "y")}, 9)::DOUBLE AS near_edited, round({like("x", "z")}, 9)::DOUBLE AS near_next,
        len(differing)::BIGINT AS n_differing, coalesce(differing[1], '') AS first_differing
    FROM l
    """
