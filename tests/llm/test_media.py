"""WebP, WARC, licences and Merkle trees: round trips and brute force."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark.llm import licences, media, merkle, warc, webp


def code(symbols, size):
    lengths = [0] * size
    for s in symbols:
        lengths[s] = 1
    return tuple(lengths)


def balanced(symbols, size):
    weights = [0] * size
    for s in symbols:
        weights[s] = 1
    if len(symbols) == 1:
        return code(symbols, size)
    return webp.huffman(weights)


class Stream:
    """Writes a stream of pixels as literals, references and cache entries."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += webp._number(value, n)

    def image(self, ops, main, cache_bits=0, extra=""):
        """ops: ("lit", argb), ("ref", length symbol and bits, distance symbol and bits), ("cache", index)."""
        self.bits += "1" + webp._number(cache_bits, 4) if cache_bits else "0"
        self.bits += extra or ("0" if main else "")
        sets = [set(), set(), set(), set(), set()]
        for kind, *x in ops:
            if kind == "lit":
                a, r, g, b = webp._channels(x[0])
                for s, v in zip(sets, (g, r, b, a)):
                    s.add(v)
            elif kind == "ref":
                sets[0].add(256 + x[0])
                sets[4].add(x[2])
            else:
                sets[0].add(280 + x[0])
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        lengths = [balanced(sorted(s) or [0], n) for s, n in zip(sets, sizes)]
        codes = [webp.canonical(n) for n in lengths]
        for n in lengths:
            self.bits += webp.write_code(n)
        for kind, *x in ops:
            if kind == "lit":
                a, r, g, b = webp._channels(x[0])
                self.bits += codes[0][g] + codes[1][r] + codes[2][b] + codes[3][a]
            elif kind == "ref":
                self.bits += codes[0][256 + x[0]] + x[1] + codes[4][x[2]] + x[3]
            else:
                self.bits += codes[0][280 + x[0]]


def literals(pixels):
    return [("lit", int(p)) for p in pixels]


def test_round_trip_of_samples():
    rnd = random.Random(1)
    for n in (64, 128, 6400, 64 * (1 << 14) + 64):
        payload = bytes(rnd.choices(range(256), k=min(n, 6400))).ljust(n, b"e")
        assert webp.samples(webp.encode_samples(payload))[:n] == payload
    with pytest.raises(ValueError):
        webp.encode_samples(b"x")
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBPVP8 ")
    for payload in (random.Random(2).randbytes(640), (b"some words that are written again. " * 40)[:1280], b"abcdefgh" * 160):
        with pytest.raises(ValueError, match="early|without symbols|outside|incomplete|no complete|too many"):
            webp.decode(webp.encode_samples(payload)[:-12])


def test_round_trip_of_every_form():
    """Palettes of all sizes, repeats near and far, scripts, long runs, slabs, one kind of byte."""
    rnd = random.Random(2)
    prose = " ".join(rnd.choice(["harbour", "wind", "letters", "quiet", "rose"]) + str(rnd.randrange(99)) for _ in range(400))
    some = [bytes(rnd.choices(range(k), k=640)) for k in (1, 2, 3, 4, 5, 16, 17)]
    some += [prose, prose + prose, "привет мир " * 40, "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(900)), "ab" * 9000, "x" * 100_000, (prose * 3)[: 2 * webp.LONGEST + 9], "123,456;" * 50]
    some.append(rnd.randbytes(3000) + b"z" * 5000 + rnd.randbytes(3000))
    raw = [t.encode() if isinstance(t, str) else t for t in some]
    used = set()
    for t in raw:
        payload = t.ljust(-(-len(t) // 64) * 64, b"\0")
        file = webp.encode_samples(payload)
        assert webp.samples(file)[: len(payload)] == payload and webp.encode_samples(payload) == file
        assert ((webp.decode(file) >> 8) & 255).astype(np.uint8).tobytes()[: len(payload)] == payload
        used.add((len(set(payload)) <= 16, len(webp.references(payload)[0]) > 0))
        if len(set(t)) > 17 and t is not raw[-1]:
            assert len(file) < 0.85 * len(payload) + 150, (t[:20], len(file), len(payload))
    assert used == {(True, True), (True, False), (False, True), (False, False)} or {(False, True), (False, False)} <= used
    long = prose.encode() * 400
    long = long[: min(webp.SLAB + 64 * 5000, len(long) // 64 * 64)]
    assert webp.samples(webp.encode_samples(long))[: len(long)] == long and len(webp.encode_samples(long)) < len(long) / 20


def test_references_repeat_what_they_say():
    payload = b"0123456789abcdefghij" * 3 + b"--" + b"0123456789abcdefghij" + b"q" * 40
    start, length, back = webp.references(payload)
    done = 0
    for a, n, d in zip(start.tolist(), length.tolist(), back.tolist()):
        assert a >= done and d <= a and n >= webp.LEAST and all(payload[a + i] == payload[a + i - d] for i in range(n))
        done = a + n
    assert length.sum() >= 40 + 12 + 30


def test_literals_references_and_cache():
    s = Stream()
    s.bits += "0"
    a, b = 0xFF102030, 0xFF405060
    shift = 32 - 3
    place = 0x1E35A7BD * a % (1 << 32) >> shift
    # a b, then length 4 from two pixels before (distance symbol: the second near code is (1, 0)... by plain distance 120 + 2)
    ops = [("lit", a), ("lit", b), ("ref", 3, "", 13, webp._number(122 - 1 - 96, 5)), ("cache", place), ("lit", b)]
    s.image(ops, True, cache_bits=3)
    assert webp.decode(webp.container(8, 1, s.bits)).tolist() == [[a, b, a, b, a, b, a, b]]


def test_near_distances():
    s = Stream()
    s.bits += "0"
    row = [0xFF000000 | i for i in (1, 2, 3, 4)]
    s.image([*literals(row), ("ref", 3, "", 0, "")], True)  # near code 1: the pixel above
    assert webp.decode(webp.container(4, 2, s.bits)).tolist() == [row, row]
    assert len(set(webp.NEAR)) == 120


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    rnd = np.random.default_rng(mode)
    width, height = 9, 7
    image = rnd.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)
    flat = image.tolist()
    residual = []
    for at, p in enumerate(flat):
        y, x = divmod(at, width)
        guess = (flat[at - 1] if x else webp.BLACK) if y == 0 else flat[at - width] if x == 0 else webp.predict(mode, flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1])
        residual.append(webp._join((c - g) % 256 for c, g in zip(webp._channels(p), webp._channels(guess))))
    s = Stream()
    s.bits += "1" + webp._number(webp.PREDICTOR, 2) + webp._number(0, 3)
    s.image(literals([0xFF000000 | mode << 8] * 6), False)
    s.bits += "0"
    s.image(literals(residual), True)
    assert webp.decode(webp.container(width, height, s.bits)).ravel().tolist() == flat


def test_predictions():
    l, t, c, r = 0xFF102030, 0x80FF0010, 0x10203040, 0x01020304
    assert webp.predict(0, l, t, c, r) == 0xFF000000 and [webp.predict(m, l, t, c, r) for m in (1, 2, 3, 4)] == [l, t, r, c]
    assert webp.predict(7, l, t, c, r) == webp._join((a + b) // 2 for a, b in zip(webp._channels(l), webp._channels(t)))
    assert webp.predict(12, l, t, c, r) == webp._join(min(max(a + b - d, 0), 255) for a, b, d in zip(webp._channels(l), webp._channels(t), webp._channels(c)))
    assert webp.predict(11, 0, 0, 5, 0) == 0


def test_cross_colour_and_subtract_green():
    rnd = np.random.default_rng(3)
    image = rnd.integers(0, 1 << 32, 30, dtype=np.uint64).astype(np.uint32)
    tile = 0xFF000000 | 0xF3 << 16 | 0x21 << 8 | 0x8F
    signed = lambda v: v - 256 if v > 127 else v
    out = []
    for p in image.tolist():
        a, r, g, b = webp._channels(p)
        r, b = (r - g) % 256, (b - g) % 256  # subtract green first, then the colour transform
        nr = (r - (signed(0x8F) * signed(g) >> 5)) % 256
        nb = (b - (signed(0x21) * signed(g) >> 5) - (signed(0xF3) * signed(r) >> 5)) % 256
        out.append(webp._join((a, nr, g, nb)))
    s = Stream()
    s.bits += "1" + webp._number(webp.SUBTRACT_GREEN, 2) + "1" + webp._number(webp.CROSS_COLOUR, 2) + webp._number(1, 3)
    s.image(literals([tile]), False)
    s.bits += "0"
    s.image(literals(out), True)
    assert webp.decode(webp.container(6, 5, s.bits)).ravel().tolist() == image.tolist()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette(colours):
    rnd = np.random.default_rng(colours)
    table = rnd.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    width, height = 11, 5
    index = rnd.integers(0, colours, (height, width))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each = 8 >> packed
    across = -(-width >> packed)
    green = np.zeros((height, across), np.int64)
    for x in range(width):
        green[:, x >> packed] |= index[:, x] << (x & (1 << packed) - 1) * each
    deltas = np.diff(np.concatenate([np.zeros((1, 4), np.uint8), table.view(np.uint8).reshape(-1, 4)]), axis=0).astype(np.uint8).view("<u4").ravel()
    s = Stream()
    s.bits += "1" + webp._number(webp.INDEXING, 2) + webp._number(colours - 1, 8)
    s.image(literals(deltas), False)
    s.bits += "0"
    s.image(literals((0xFF000000 | green << 8).ravel()), True)
    assert (webp.decode(webp.container(width, height, s.bits)) == table[index]).all()


def test_meta_codes():
    """Two groups of codes, chosen by a tile image."""
    s = Stream()
    s.bits += "0" + "0" + "1" + webp._number(0, 3)  # no transform, no cache, tiles of 4 x 4
    s.image(literals([0xFF000000, 0xFF000100]), False)
    first, second = 0xFF0000AA, 0xFF00BB00
    for p in (first, second):
        a, r, g, b = webp._channels(p)
        for v, n in ((g, 280), (r, 256), (b, 256), (a, 256), (0, 40)):
            s.bits += webp.write_code(code([v], n))
    found = webp.decode(webp.container(8, 1, s.bits))
    assert found.tolist() == [[first] * 4 + [second] * 4]


def test_media_columns(docs, rows, empty, clashing):
    found = {r.doc_id: r for r in media.read_media(media.write_media(docs)).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, bytes(r.samples), r.tail_crc32) == (len(raw), len(payload), payload, zlib.crc32(payload[-64:]))
    assert media.write_media(empty).count() == 0 and media.read_media(media.write_media(clashing)).count() == 4


PAGES = "page_id bigint, url string, html string, archive string"


@pytest.fixture(scope="module")
def pages(spark):
    long, longer = "<p>" + "é" * 60, "<h1>" + "x\r\n\r\n" * 4000
    some = [(5, "http://a/é x\r\nInjected: 1", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", longer), (7, "u", "WARC/1.1\r\n\r\n" * 30), (8, "u", longer), (None, "u", long), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99)]
    return spark.createDataFrame([(*x, "clash") for x in some], PAGES).repartition(2), some


def test_warc_round_trip(pages):
    frame, some = pages
    found = warc.round_trip(frame).collect()
    assert Counter(r.page_id for r in found) == Counter(x[0] for x in some)
    least = {}
    for key, _, html in some:
        if key is not None:
            least[html] = min(key, least.get(html, key))
    for key, _, html in some:
        raw = (html or "").encode()
        r = next(r for r in found if r.page_id == key)
        revisit = len(raw) >= 100 and least.get(html) not in (None, key)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[html] if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == raw


def test_members_and_sidecar(pages, spark, tmp_path):
    frame, some = pages
    folder = f"file://{tmp_path}"
    whole = warc.write(warc.records(frame), folder, archive_bytes=10_000)
    names = [r.archive for r in whole.collect()]
    assert len(names) > 1
    fresh = [r.archive for r in warc.normalise(whole, folder).collect()]
    inflate = lambda name: gzip.decompress((tmp_path / name).read_bytes())
    assert sorted(map(inflate, names)) == sorted(map(inflate, fresh))
    places = [p for n in fresh for p in warc._members(*warc._open(folder), n)]
    assert len(places) == len(some) and all(raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") for _, raw in places)
    assert b"\nInjected" not in b"".join(raw.split(b"\r\n\r\n")[0] for _, raw in places) and urlparse(folder).path == str(tmp_path)


def test_very_long_payloads(spark):
    """Payloads over the pieces in which archives are inflated, equal ones among them; columns that clash with inner ones."""
    long = "".join(chr(97 + i % 23) for i in range(3_000_000))
    rows = [(1, "http://a/", long, "k", 1), (2, None, long, "k", 1), (3, "", long + "x", "k", 1), (4, "u", "x" * 99, "k", 1), (5, "u", "x" * 99, "k", 1)]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, digest int")).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in found.items()} == {1: ("response", None, 3_000_000), 2: ("revisit", 1, 3_000_000), 3: ("response", None, 3_000_001), 4: ("response", None, 99), 5: ("response", None, 99)}
    assert bytes(found[3].payload).decode() == long + "x" and found[2].payload_digest == hashlib.sha256(long.encode()).hexdigest()


def test_very_long_texts_of_native_operators(spark):
    rnd = random.Random(3)
    long = "\n".join(" ".join(f"w{rnd.randrange(10**5)}" for _ in range(40)) + ("\n" if i % 50 == 0 else "") for i in range(3000))
    frame = spark.createDataFrame([(1, long, "c"), (2, long + "!", "c"), (3, "Released under the MIT License.\n" + long, "c")], "doc_id bigint, text string, hash string")
    found = {r.doc_id: r for r in merkle.edits(frame).collect()}
    assert found[2].n_chars == len(long) + 1 and found[2].near_next > 0.99 and found[1].fingerprint != found[2].fingerprint
    assert {r.doc_id: r.declared for r in licences.scan(frame).collect()} == {1: None, 2: None, 3: "MIT"}
    read = {r.doc_id: r for r in media.read_media(media.write_media(frame)).collect()}
    assert bytes(read[1].samples)[: len(long)] == long.encode() and read[1].media_bytes < len(long)


def test_cut_archives_raise(spark, tmp_path):
    """Streams cut inside a record, at the edge of one behind a flush, or short of a whole record: none is read in silence."""
    records = [warc.record_bytes(i, "http://a/", b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), None, False) for i in range(50)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    half = z.compress(b"".join(records[:25])) + z.flush(zlib.Z_FULL_FLUSH)
    whole = half + z.compress(b"".join(records[25:])) + z.flush()
    members = b"".join(map(gzip.compress, records))
    for name, raw, n in (("whole", whole, 50), ("members", members, 50)):
        (tmp_path / name).write_bytes(raw)
        frame = spark.createDataFrame([(name, n)], "archive string, records bigint")
        assert warc.read(warc.normalise(frame, f"file://{tmp_path}"), f"file://{tmp_path}").count() == 50
    for name, raw, n, why in (("edge", half, 50, "inside a gzip member"), ("inside", whole[:-300], 50, "inside a"), ("fewer", gzip.compress(b"".join(records[:25])), 50, "25 records"), ("record", gzip.compress(records[0][:-9]), 1, "inside a record")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=why):
            warc.normalise(spark.createDataFrame([(name, n)], "archive string, records bigint"), f"file://{tmp_path}")


def test_inflation_is_bounded():
    """A small file of one long run of zeros comes in pieces of bounded size."""
    import io

    sizes = [len(x) for x in warc.inflated(io.BytesIO(gzip.compress(bytes(50 << 20)) * 2))]
    assert sum(sizes) == 100 << 20 and max(sizes) <= warc.PIECE


def test_warc_odd_tables(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    twice = spark.createDataFrame([(1, "u", "a" * 200, "")] * 2, PAGES)
    assert [r.record_type for r in warc.round_trip(twice).collect()] == ["response"] * 2
    with pytest.raises(ValueError):
        list(warc.records_of(iter([b"WARC/1.1\r\ncontent-length: 9\r\n\r\nabc"])))


def test_licences(spark):
    mit = licences.TEXTS[0][1]
    some = [
        (1, mit),
        (2, f"Copyright (c) 2020 A. Person\n  (C) 2021 Another\n\n{mit.upper().replace('SUBLICENSE', 'SUB-LICENCE')}"),
        (3, mit + " and more"),
        (4, "Prose.\nReleased under the MIT Licence.\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0\nlicensed to nobody"),
        (5, None),
        (6, ""),
        (7, "(c) 2001 A.  All rights reserved.\n  ALL RIGHTS  RESERVED"),
        (None, "Released under the MIT License."),
        (None, "Released under the MIT License."),
    ]
    found = licences.scan(spark.createDataFrame([(*x, "c", "d") for x in some], "doc_id bigint, text string, kind string, digest string")).collect()
    assert Counter((r.doc_id, r.license_id, r.declared) for r in found) == {(1, "MIT", None): 1, (2, "MIT", None): 1, (3, None, None): 1, (4, None, "Apache-2.0,MIT"): 1, (5, None, None): 1, (6, None, None): 1, (7, None, "All rights reserved"): 1, (None, None, "MIT"): 2}
    assert licences.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_licences_of_whole_files(spark):
    """Texts of a folder of licences, wrapped and cased otherwise, among prose and a licence within a longer text."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0-Perl"}
    want = {k: v for k, v in want.items() if (folder / k).exists()}
    if not want:
        pytest.skip("no licence texts here")
    texts = {k: (folder / k).read_text() for k in want}
    rows = [(k, t) for k, t in texts.items()] + [(f"{k} ", " ".join(t.swapcase().split())) for k, t in texts.items() if not re.search(r"(?i)copyright (\(c|\[)", t)] + [("within", "Read this.\n" + next(iter(texts.values()))), ("prose", "Nothing of the kind.")]
    found = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {k: want.get(k.strip()) for k, _ in rows}
    more = spark.createDataFrame([("Nothing of the kind.",)], "t string").select(F.lit("text").alias("kind"), licences.digest(F.col("t")).alias("digest"), F.lit("Own").alias("license"))
    assert {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), more=more).collect()}["prose"] == "Own"
    assert len(licences.DIGESTS) == len(set(licences.DIGESTS)) and all(len(d) == 64 for _, d in licences.DIGESTS)
    assert all(any(x in t.lower() for x in licences.SPEAKS) for _, t in licences.LINES)


def test_merkle_edits(spark, docs, rows):
    shuffled = [(i * 97, t) for i, t, *_ in rows] + [(10**12, "far"), (-5, "below")]
    order = sorted(shuffled, reverse=True)
    found = {r.doc_id: r for r in merkle.edits(spark.createDataFrame([*shuffled, (None, "abcdef")], "doc_id bigint, text string")).collect()}
    assert len(found) == len(shuffled) + 1 and found[None].edited == "abcd" and found[None].near_next == 0
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        assert (found[i].n_chars, found[i].edited) == (len(t), t[: len(t) - k] + nxt[:k])
        assert (found[i].fingerprint == found[i].edited_fingerprint) == (t == found[i].edited)
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        if len(t) > 1000:
            assert found[i].near_edited > 0.4 > found[i].near_next


def test_merkle_branches(spark):
    a, b = "one\ntwo\n\nthree\nfour", "one\ntwo!\n\nthree\nfour\nfive"
    digests = lambda c: merkle.paragraph_digests(merkle.tree(F.col(c)))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differing(digests("a"), digests("b")).alias("d"), merkle.differing(digests("a"), digests("a")).alias("same")).first()
    assert [tuple(x) for x in row.d] == [(0, 1), (1, 2)] and row.same == []


def test_merkle_roots_are_of_whole_digests(spark):
    """Leaves are cut in the list alone: the root follows from whole digests, and edits are told by their places."""
    text = "x" * 70 + "\nsecond\n\nthird"
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    leaves = [["x" * 64, "x" * 6], ["second"], ["third"]]
    p = [md5("".join(map(md5, some))) for some in leaves]
    want = md5(md5(p[0] + p[1]) + md5(p[2])) + ":" + "".join(md5(x)[:8] for some in leaves for x in some)
    found = {r.doc_id: r for r in merkle.edits(spark.createDataFrame([(1, text), (2, "other\n" * 40)], "doc_id bigint, text string")).collect()}
    assert found[1].fingerprint == want
    k = len(text) // 3
    edited = text[: len(text) - k] + ("other\n" * 40)[:k]
    old, new = ([s.split("\n") for s in t.split("\n\n")] for t in (text, edited))
    width = lambda t, i: len(t[i]) if i < len(t) else 0
    cell = lambda t, i, j: t[i][j] if i < len(t) and j < len(t[i]) else None
    places = [(i, j) for i in range(max(len(old), len(new))) for j in range(max(width(old, i), width(new, i))) if cell(old, i, j) != cell(new, i, j)]
    assert [tuple(x) for x in found[1].differing] == places


def test_merkle_repeated_rows_and_empty(spark):
    twice = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "xyzxyz")], "doc_id bigint, text string")
    found = merkle.edits(twice).collect()
    assert Counter((r.doc_id, r.edited) for r in found) == {(2, "xyzxab"): 1, (1, "aba"): 1, (1, "abx"): 1}
    assert len({r.fingerprint for r in found}) == 2
    assert merkle.edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("group", [1 << 16, 7])
def test_next_rows(spark, group):
    """Hashed ids, dense ones, and one that a third of all rows repeats, in many groups and in few."""
    import xxhash

    rnd = random.Random(2)
    rows = [(rnd.getrandbits(64) - (1 << 63), f"a{i}") for i in range(200)] + [(i, f"b{i}") for i in range(100)] + [(77, f"c{i}") for i in range(150)]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0], signed(r[1]), r[1]), reverse=True)
    want = Counter((*a, b[1]) for a, b in zip(order, order[1:] + order[:1]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = merkle.with_next(frame, group=group)
    assert Counter(map(tuple, found.collect())) == want
    if group == 7:
        bounds = merkle.bounds_of(frame, 64)
        sizes = Counter(r.g for r in frame.withColumn("hash", F.xxhash64("text")).select(merkle.group_of(bounds).alias("g")).collect())
        assert max(sizes.values()) < 40 and len(sizes) > 50


def test_next_rows_of_many_hashed_ids(spark):
    """No task holds much more than its share of 10**5 hashed ids."""
    frame = spark.range(100_000).select(F.xxhash64("id").alias("doc_id"))
    bounds = merkle.bounds_of(frame, 50)
    sizes = [r["count"] for r in frame.withColumn("hash", F.lit(0)).groupBy(merkle.group_of(bounds).alias("g")).count().collect()]
    assert len(sizes) == 50 and max(sizes) < 2 * 100_000 / 50
