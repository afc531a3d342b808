"""Fingerprints, components, substrings and quality against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cubespark.llm import components, quality, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, near):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_classes(docs, rows):
    want = [brute_print(t) for _, t, *_ in rows]
    roots = brute_classes(want, lambda a, b: (a ^ b).bit_count() <= 3)
    found = {r.doc_id: r for r in simhash.classes(docs).collect()}
    assert len(found) == len(rows)
    for (i, *_), p, root in zip(rows, want, roots):
        assert found[i].print % (1 << 64) == p and found[i].component_id == root


def test_simhash_odd_tables(clashing, empty):
    found = simhash.classes(clashing).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == {(None, 7): 1, (7, 7): 2, (8, 8): 1}
    assert simhash.classes(empty).count() == 0


def test_simhash_of_a_very_long_text(spark, monkeypatch):
    """More hashes than are counted at a time, among short texts."""
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(n)) for n in (3, 20_000, 0, 7)]
    import pyarrow as pa

    found = np.concatenate([simhash.block_prints(b) for b in simhash.blocks_of(pa.array(texts))])
    assert found.tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("pieces", [4, 5, 6])
def test_bk_forest_finds_every_link(spark, pieces):
    """Dense groups, pairs at every distance to 5, and strangers."""
    rnd = random.Random(pieces)
    some = [rnd.getrandbits(64) for _ in range(150)]
    for base in some[:30]:
        for k in range(1, 6):
            x = base
            for b in rnd.sample(range(64), k):
                x ^= 1 << b
            some.append(x)
    some += [some[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    some = sorted(set(some))
    want = brute_classes(some, lambda a, b: (a ^ b).bit_count() <= 3)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in some], "print bigint")
    links = simhash.near_links(frame, pieces=pieces)
    groups = defaultdict(set)
    for r in components.components(links).collect():
        groups[r.root].add(r.node % (1 << 64))
    brute = defaultdict(set)
    for x, root in zip(some, want):
        brute[root].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in brute.values() if len(g) > 1)


def test_components_of_long_chains(spark):
    links = [(i + 1, i) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3), (1000, 1001)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def brute_cut(texts, window):
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


@pytest.mark.parametrize("window", [35, 20, 9])
def test_substrings(docs, rows, window):
    want = brute_cut([t for _, t, *_ in rows], window)
    found = {r.doc_id: r for r in substrings.cut(docs, window=window, keep=("lang",)).collect()}
    assert len(found) == len(rows)
    for (i, *_), w in zip(rows, want):
        assert (found[i].kept, found[i].n_words, found[i].n_removed, found[i].lang) == (*w, "en")
    assert window != 35 or sum(w[2] for w in want) > 400


def test_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substrings_odd_tables(clashing, empty):
    found = substrings.cut(clashing, window=4).collect()
    assert Counter((r.doc_id, r.n_removed) for r in found) == {(None, 4): 1, (7, 4): 2, (8, 0): 1}
    assert substrings.cut(empty).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    """Prose and junk, labelled by what they are."""
    rnd, rows, labels = random.Random(8), [], []
    for i in range(400):
        prose = [rnd.choice(["the", "of", "harbour", "wind", "letters", "and", "quiet", "rose", "stone"]) for _ in range(rnd.randrange(5, 200))]
        good = rnd.random() < 0.7
        text = " ".join(prose).capitalize() + "." if good else " ".join(f"{w.upper()}!!" if i % 2 else f"{w}$$$" for w in prose)
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(good)))
    labels += [(0, None), (10**6, 1)]
    return spark.createDataFrame([*rows, (None, None)], "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(rows), labels


def test_quality_on_the_held_out_fold(marked):
    docs, labels, _, known = marked
    found = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted").collect()}
    assert len(found) == 401 and not found[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    out = [(found[i].predicted, q) for i, q in known if i in found and q is not None and found[i].held_out]
    assert len(out) > 50 and np.mean([a == b for a, b in out]) > 0.97


def test_quality_uses_no_held_out_label_and_no_other_input(marked, spark):
    docs, labels, _, _ = marked
    from pyspark.sql import functions as F

    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs.withColumn("Text2", F.lit(1)), wrong)
    assert np.allclose(a.means, b.means) and np.allclose(a.constants, b.constants)
    with pytest.raises(ValueError, match="both classes"):
        quality.fit(docs, labels.filter("quality = 1"))


def test_quality_of_odd_rows(marked, clashing, empty, spark):
    model = quality.fit(*marked[:2])
    odd = spark.createDataFrame([(None, None, 9.0, 7), (1, "", 9.0, 7), (1, "", 9.0, 7), (2, "x" * 100_000, 9.0, 7)], "doc_id bigint, text string, score double, predicted int")
    found = quality.score(odd, model).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found) and found[1] == found[2]
    assert quality.score(empty, model).count() == 0 and quality.score(clashing, model).count() == 4
    with pytest.raises(ValueError, match="both classes"):
        quality.fit(empty, marked[1])


def test_discriminant_is_the_gaussian_one():
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(0, 1, (300, 20)), rnd.normal(1, 2, (200, 20))])
    y = np.repeat([1, 0], [300, 200])
    model = quality.discriminant(x, y)
    z = (x - model.centre) / model.scale
    for k in (0, 1):
        precision = model.factors[k].T @ model.factors[k]
        d = z[:5] - model.means[k]
        assert np.allclose((d @ precision * d).sum(axis=1), ((d @ model.factors[k].T) ** 2).sum(axis=1))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
