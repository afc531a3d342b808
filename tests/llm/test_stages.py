"""The pipeline's own stages against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from cubespark.llm import likeness, quality, stages

from test_dedup import LOWER, WORD, brute_classes, brute_cut


def brute_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness_of(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited_texts():
    """Texts and copies with words changed: likenesses on both sides of 0.8, 0.8 itself, chains, and many with one passage."""
    rnd = random.Random(3)
    draw = lambda n: [f"v{rnd.randrange(3000)}" for _ in range(n)]
    passage, some = draw(40), []
    for n in (5, 9, 40, 120, 400):
        for _ in range(12):
            base = draw(n)
            some.append(base)
            for changes in (1, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(changes):
                    copy[rnd.randrange(n)] = "changed"
                some.append(copy)
    chain = draw(54)
    some += [chain[i : i + 44] for i in range(0, 11)]
    exact = draw(54)  # 50 shingles; of 44 words 40, all among them: 40 / 50
    some += [exact, exact[:44]]
    some += [draw(rnd.randrange(5, 30)) + passage + draw(rnd.randrange(5, 30)) for _ in range(80)]
    return [None, "", "One two", "one  TWO", *(" ".join(w) for w in some)]


@pytest.mark.parametrize("most", [likeness.MOST, 9])
def test_stage_near_copies_are_those_of_likeness(spark, monkeypatch, most):
    """Representatives of the stage as by brute-force Jaccard, with buckets whole and cut in slots."""
    monkeypatch.setattr(likeness, "MOST", most)
    texts = edited_texts()
    sets = [brute_set(t) for t in texts]
    roots = brute_classes(sets, lambda a, b: likeness_of(a, b) >= 0.8)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = sorted(r.doc_id for r in stages.drop_similar(spark, docs, "").collect())
    assert kept == sorted(set(roots)) and 100 < len(kept) < len(texts) - 60
    assert any(likeness_of(sets[i], sets[j]) == 0.8 for i in range(len(sets)) for j in range(i))


def test_likeness_of_odd_tables(clashing, empty, spark):
    assert likeness.representatives(empty).count() == 0
    assert Counter(r.doc_id for r in likeness.representatives(clashing).collect()) == {None: 1, 7: 1, 8: 1}
    again = spark.createDataFrame([(3, "a b c d e f"), (7, "A b c d e f"), (7, "other words that nothing shares")], "doc_id bigint, text string")
    assert sorted(map(tuple, likeness.representatives(again).collect())) == [(3, "a b c d e f"), (7, "other words that nothing shares")]


def test_stage_leaves_uncut_documents_as_they_are(spark, docs, rows):
    """Rows that nothing is cut from keep text and n_chars, null, empty and blank ones too."""
    stage = dict(corpus_pipeline.STAGES)["substring_dedup"]
    marked = [(i, t, lang, source, n + 1000) for i, t, lang, source, n in rows]
    found = {r.doc_id: r for r in stage(spark, spark.createDataFrame(marked, docs.schema).repartition(3), "").collect()}
    want = {}
    for (i, t, lang, source, n), (kept, n_words, n_removed) in zip(marked, brute_cut([t for _, t, *_ in rows], 35)):
        if not n_removed:
            want[i] = (i, t, lang, source, n)
        elif n_words > n_removed:
            want[i] = (i, kept, lang, source, len(kept))
    assert {i: tuple(r) for i, r in found.items()} == want
    assert want[0][1] is None and want[1][1] == "" and want[2][1] == " \t\n" and any(w[1] and "\n" in w[1].strip() for w in want.values())


EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, predicted string, kept string, n_words string, n_removed string, key string, id string, no_text string, c0 string"


def odd_corpus():
    """Prose and junk, near copies, shared passages, null, empty and very long texts, null and repeated doc_ids; labels by kind."""
    rnd = random.Random(11)
    pool = [f"{rnd.choice(['har', 'wind', 'let', 'quiet', 'sto', 'ro'])}{rnd.choice('aeiou')}{i}" for i in range(3000)]
    prose = lambda n: " ".join(rnd.choice(pool) for _ in range(n)).capitalize() + "."
    passage, rows, labels = prose(60), [], []
    for i in range(160):
        good = i % 4 != 0
        text = prose(rnd.randrange(30, 160))
        rows.append([i, text if good else " ".join(f"{w.upper()}$$$" for w in text.split())])
        if i % 8 not in (2, 4):
            labels.append((i, int(good)))
    rows += [[1000 + i, rows[i][1].replace(" ", "  ", 3)] for i in range(0, 40, 3)]
    rows += [[1100 + i, rows[i][1] + " tail"] for i in range(1, 40, 5)]
    rows += [[1200 + i, f"{prose(50)}\n{passage}\n{prose(40)}"] for i in range(8)]
    rows += [[1300, prose(30_000)], [1301, None], [1302, ""], [1303, " \n"], [None, prose(50)], [None, prose(50)], [1304, passage]]
    rows += [[7, "wholly other words than those that the same doc_id has elsewhere. " + prose(60)], [1305, rows[7][1]], [1305, rows[7][1]]]
    return [(i, t, "en", "s", len(t or ""), *"spkwricn0") for i, t in rows], labels


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    """All stages on an odd corpus: what stays, what is cut, every piece and every sequence; extra columns keep their values."""
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(stages._path())
    rows, labels = odd_corpus()
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").withColumns({"toxic": stages.F.lit(0)}).write.parquet(f"{tmp_path}/labels.parquet")
    docs = stages.documents(spark, str(tmp_path))
    # Stage 1: the model is taken as it is; that its decisions take effect, and nothing else changes, is what is held here.
    judged = quality.score(docs.drop("score", "predicted"), quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()
    good = [r for r in rows if next(j.predicted for j in judged if (j.doc_id, j.text) == r[:2])]
    first = stages.keep_quality(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and Counter(map(tuple, first.collect())) == Counter(good) and 60 < len(good) < len(rows) - 20
    # Stage 2
    sets = [brute_set(t) for _, t, *_ in good]
    roots = brute_classes(sets, lambda a, b: likeness_of(a, b) >= 0.8)
    groups = defaultdict(list)
    for r, root in zip(good, roots):
        groups[root].append(r)
    rank = lambda r: (r[0] is None, r[0])
    alone = [min((r for r in g if r[0] is not None), key=rank) for g in groups.values() if any(r[0] is not None for r in g)] + [r for r in good if r[0] is None]
    second = stages.drop_similar(spark, first, "")
    assert second.columns == docs.columns and Counter(map(tuple, second.collect())) == Counter(alone) and len(alone) < len(good) - 5
    # Stage 3
    want = []
    for r, (kept, n_words, n_removed) in zip(alone, brute_cut([t for _, t, *_ in alone], 35)):
        if not n_removed:
            want.append(r)
        elif n_words > n_removed:
            want.append((r[0], kept, *r[2:4], len(kept), *r[5:]))
    third = stages.cut_passages(spark, second, "")
    assert third.columns == docs.columns and Counter(map(tuple, third.collect())) == Counter(want) and want != alone
    # Stage 4, and the whole run
    pieces, found = Counter(), corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in want:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        head = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        for k, at in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[at : head if not k else at + 1024]
            pieces[r[0], k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in found) == pieces
    bins = defaultdict(list)
    for p in found:
        bins[p.sequence_id].append((p.offset, p.length))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1 + -(-sum(p.length for p in found) // 1024) * 1.05


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
