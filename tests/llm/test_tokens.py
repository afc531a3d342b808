"""Encoding, counting and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from cubespark.llm import bpe, packing, pretokens, transducer
from cubespark.llm.blocks import blocks_of

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_as_the_library(docs, rows, library):
    found = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        want = ids_of(library, text)
        assert list(found[i].ids) == want
        assert found[i].decoded == library.decode(want, skip_special_tokens=False)


def test_encoding_leaves_no_table(spark, docs):
    """The bucketed files need a table's name only until they are read; the frame outlives it."""
    before = [t.name for t in spark.catalog.listTables()]
    encoded = bpe.encode(docs, PATH)
    assert [t.name for t in spark.catalog.listTables()] == before and encoded.count() == docs.count() == encoded.filter("size(ids) >= 0").count()


def test_encode_odd_tables(clashing, empty):
    assert sorted(map(str, (r.doc_id for r in bpe.encode(clashing, PATH).collect()))) == ["7", "7", "8", "None"]
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    with pytest.raises(ValueError, match="missing"):
        bpe.encode(clashing.drop("text"), PATH)


def test_decode_broken_and_unknown_ids(spark, library):
    rows = [(1, [50256, 97, 10**6, -1]), (2, [447, 10]), (3, []), (4, None)]
    found = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), PATH).collect()}
    assert found[1] == library.decode([50256, 97], skip_special_tokens=False)
    assert found[2] == library.decode([447, 10], skip_special_tokens=False)
    assert found[3] == found[4] == ""


def random_texts(n):
    rnd = random.Random(2)
    parts = [*"aab sSt'tremdvl lle  \n\t\r  　é中1２½,.!?\U0001f600’", "<|endoftext|>", "'re", "'ll", " '", "it's"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(n)]


def test_pretokens_of_random_texts(library):
    encoder, texts = pretokens.WordIds(PATH), random_texts(2000)
    for block in blocks_of(__import__("pyarrow").array(texts), 4096):
        ids, counts = encoder.block_ids(block)
        ends = np.cumsum(counts)
        for i in range(block.rows):
            assert ids[ends[i] - counts[i] : ends[i]].tolist() == ids_of(library, texts[block.first + i])


def test_classes_of_all_code_points(library):
    """The class table splits as the library does, for every code point of the planes in use."""
    encoder = pretokens.WordIds(PATH)
    texts = [f"a{chr(c)}{chr(c)}1 {chr(c)}b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    for block in blocks_of(__import__("pyarrow").array(texts)):
        ids, counts = encoder.block_ids(block)
        ends = np.cumsum(counts)
        for i in range(block.rows):
            assert ids[ends[i] - counts[i] : ends[i]].tolist() == ids_of(library, texts[block.first + i])


@pytest.mark.parametrize("chunk", [1 << 16, 3, 7])
def test_transducer_counts_and_composes(library, chunk):
    machine = transducer.transducer(PATH)
    for text in random_texts(600):
        assert machine.count(text, chunk) == len(ids_of(library, text))


def test_composition_is_associative():
    machine = transducer.transducer(PATH)
    maps = [machine.chunk_map(t) for t in ("don", "'t stop ", "thinking", "about\n\n ", "tomorrow's")]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = machine.compose(m, right)
    assert machine.value(left) == machine.value(right) == machine.value(machine.scan(maps)[-1]) == machine.count("don't stop thinkingabout\n\n tomorrow's")


def test_scan_gives_every_prefix():
    machine, text = transducer.transducer(PATH), "Ab, c3's ab'll\n\n  x -- 12z " * 9
    for size in (1, 4, 5, 11):
        cuts = [text[i : i + size] for i in range(0, len(text), size)]
        scanned = machine.scan([machine.chunk_map(c) for c in cuts])
        assert [machine.value(m) for m in scanned] == [machine.count("".join(cuts[: i + 1])) for i in range(len(cuts))]


@pytest.mark.parametrize("chunk", [5, 64])
def test_long_texts_are_dealt_out(docs, rows, library, chunk):
    """Counts of chunks that other tasks map and one composes, special strings and texts without white space among them."""
    found = {r.doc_id: r for r in transducer.count_tokens(docs.filter("doc_id < 55"), PATH, chunk=chunk).collect()}
    for i, text, *_ in rows[:55]:
        assert (found[i].n_bytes, found[i].n_tokens) == (len((text or "").encode()), len(ids_of(library, text)))


def test_segments_of_random_texts(library):
    machine, texts = transducer.transducer(PATH), random_texts(3000)
    for block in blocks_of(__import__("pyarrow").array(texts), 4096):
        want = [len(ids_of(library, texts[block.first + i])) for i in range(block.rows)]
        assert machine.block_counts(block).tolist() == want


def test_few_states_are_enough(library):
    small = transducer.CountTransducer(pretokens.byte_bpe(PATH), remember=5)
    for text in random_texts(60):
        assert small.count(text) == len(ids_of(library, text))


def test_counts_of_tables(docs, rows, clashing, empty, library):
    found = {r.doc_id: r for r in transducer.count_tokens(docs, PATH).collect()}
    for i, text, *_ in rows:
        assert (found[i].n_bytes, found[i].n_tokens) == (len((text or "").encode()), len(ids_of(library, text)))
    odd = docs.sparkSession.createDataFrame([(1, "中文，没有空格。" * 4000), (2, "x" * 40_000), (None, "a b " * 9000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in transducer.count_tokens(odd, PATH).collect()} == {r.doc_id: len(ids_of(library, r.text)) for r in odd.collect()}
    assert transducer.count_tokens(clashing, PATH).count() == 4 and transducer.count_tokens(empty, PATH).count() == 0


def check_packing(found, rows, library, capacity=packing.Capacity()):
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text, *_ in rows:
        ids = np.array([*ids_of(library, text), 2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity.max_tokens)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    full = capacity.vector()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= full[0] and len(parts) <= full[1] and sum(n * n for _, n in parts) <= full[2]
    return len(sequences), total


def test_packing(docs, rows, empty, clashing, library):
    sequences, total = check_packing(packing.pack(docs, PATH).collect(), rows, library)
    assert sequences <= -(-total // 1024) + 1
    assert packing.pack(empty, PATH).count() == 0 and packing.pack(clashing, PATH).count() == 4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(docs, rows, library, rule):
    capacity = packing.Capacity(1024, max_docs=3, max_attention=1024 * 1024 // 2 + 1024 * 512)
    check_packing(packing.pack(docs, PATH, capacity=capacity, rule=rule, weights=(1, 1, 1)).collect(), rows, library, capacity)
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.plan_best_fit({1024: 1}, packing.Capacity(1024, max_attention=100))


def test_plan_is_best_fit_one_by_one():
    """The plan by counts opens as many sequences as placing pieces one at a time does."""
    rnd = random.Random(4)
    for _ in range(20):
        counts = {rnd.randrange(1, 100): rnd.randrange(1, 30) for _ in range(25)}
        plan = packing.plan_best_fit(counts, packing.Capacity(100), (1.0, 0.0, 0.0))
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [i for i, b in enumerate(bins) if b >= length]
                if fits:
                    bins[min(fits, key=lambda i: bins[i])] -= length
                else:
                    bins.append(100 - length)
        assert plan.sequences == len(bins)
