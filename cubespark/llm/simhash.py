"""SimHash fingerprints, links within a Hamming radius by BK-trees, and their components.

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased,
shingles of ``shingle`` words joined by one space (a text with fewer words has
its whole sequence as the one shingle; without words the fingerprint is zero),
XXH64 with seed 42 of each; a bit is 1 if it is set in over half the hashes.

Links: 64 bits are cut into ``pieces`` parts.  Two fingerprints that differ in
at most ``radius`` bits agree in all the bits of some ``pieces - radius`` parts,
so they meet in the *shard* of those parts' value.  Every shard has a BK-tree:
children are keyed by their Hamming distance to the parent, and a search at
distance d from a node follows only the edges d - radius to d + radius.  A
shard's tree is built and searched in the task that its shard is dealt to; it
is not broadcast, because all trees together grow with the data.  A task
builds all its trees at once, level by level, and searches them with a frontier
of (query, node) pairs; of the links it finds it keeps a spanning forest, which
joins the same texts, so that a large group of near copies costs no row for
each of its pairs.

Equal fingerprints are one node, whatever the number of copies.

Null texts have no words; documents without words share fingerprint zero and
are linked like any other; null doc_ids have a row, and their component is the
least doc_id reachable, null if there is none; repeated rows each have a row (equal
doc_ids with unlike texts are fingerprints of their own, and their classes may differ).
Very long texts are read in full, in chunks of hashes; ties of a bit (half the hashes)
count as 0; an empty table gives an empty table; extra columns stay out.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_rows, blocks_of, ragged, renamed, stored, word_spans
from .components import components

PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Shingles whose bits are counted at a time, and search steps held at a time.
CHUNK, FRONTIER = 1 << 18, 1 << 21
#: Rows (a fingerprint in a shard, 16 bytes) that one task is dealt, about.
DEALT = 2_000_000


def block_prints(block, shingle: int = 3) -> np.ndarray:
    """Fingerprints (uint64) of the rows of a block."""
    starts, ends, counts = word_spans(block)
    data = block.data + ((block.data >= 65) & (block.data <= 90)) * np.uint8(32)
    sizes = ends - starts
    # Words of the block side by side, one space behind each: a shingle is one slice.
    places = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(places[-1] + sizes[-1] + 1) if len(sizes) else 0, 32, np.uint8)
    if len(sizes):
        joined[ragged(np.arange(len(joined)), places, sizes)] = ragged(data, starts, sizes)
    raw, finish = joined.tobytes(), places + sizes
    hashes = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.cumsum(counts) - counts
    begin = ragged(np.arange(len(starts)), first, hashes)
    row = np.repeat(np.arange(block.rows), hashes)
    last = np.minimum(begin + shingle, (first + counts)[row]) - 1
    ones = np.zeros((block.rows, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(begin), CHUNK):
        a, b = places[begin[lo : lo + CHUNK]].tolist(), finish[last[lo : lo + CHUNK]].tolist()
        h = np.fromiter((digest(raw[x:y], 42) for x, y in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[lo : lo + CHUNK]
        edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ones[rows[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    majority = (2 * ones > hashes[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()


def _prints(batches, shingle: int):
    for batch in batches:
        for block in blocks_of(batch.column(1)):
            yield as_rows(PRINTS, doc_id=batch.column(0).slice(block.first, block.rows), print=block_prints(block, shingle).view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint of every row as a bigint."""
    source = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return source.mapInArrow(functools.partial(_prints, shingle=shingle), "doc_id bigint, print bigint")


def shard_masks(radius: int, pieces: int) -> list[int]:
    """The bits of every choice of pieces - radius parts."""
    bounds = [64 * i // pieces for i in range(pieces + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [sum(x) for x in itertools.combinations(parts, pieces - radius)]


class BkForest:
    """BK-trees over the runs of equal ``shard`` in sorted order; nodes are positions.

    edges: parent * 65 + distance of every node but the roots, sorted, with ``child`` beside it.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints
        n = len(prints)
        at = np.arange(n)
        new = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root = at[new][np.cumsum(new) - 1] if n else at
        edges, children = [], []
        open_, parent = at[~new], self.root[~new]
        while len(open_):
            key = parent * 65 + np.bitwise_count(prints[open_] ^ prints[parent])
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            edges.append(key[first])
            children.append(open_[first])
            parent = open_[first][np.cumsum(first) - 1][~first]  # the others go down that edge
            open_ = open_[~first]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def links(self, radius: int):
        """Pairs (query, node), query < node, within the radius; a bounded number at a time."""
        alone = self.root == np.arange(len(self.root))
        has = np.zeros(len(self.root), bool)
        has[self.root[~alone]] = True
        queries = np.flatnonzero(~alone | has)
        waiting = [(q, self.root[q]) for q in np.array_split(queries, max(1, len(queries) // (FRONTIER // 16)))]
        while waiting:
            query, node = waiting.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                waiting += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
            near = (far <= radius) & (query < node)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(far - radius, 0))
            many = np.searchsorted(self.edge, node * 65 + np.minimum(far + radius, 64), side="right") - low
            if many.any():
                step = FRONTIER
                total = np.cumsum(many)
                cuts = np.searchsorted(total, np.arange(step, total[-1] + step, step))
                for a, b in zip([0, *(cuts[:-1] + 1)], cuts + 1):
                    if a < b and many[a:b].any():
                        waiting.append((np.repeat(query[a:b], many[a:b]), ragged(self.child, low[a:b], many[a:b])))


class Forest:
    """Least labels of what links have joined so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
            self.label = label


def _shard_links(batches, radius: int):
    shard, prints = [], []
    for batch in batches:
        shard.append(batch.column("shard").to_numpy())
        prints.append(batch.column("print").to_numpy().view(np.uint64))
    if not shard:
        return
    shard, prints = np.concatenate(shard), np.concatenate(prints)
    order = np.lexsort((prints, shard))
    shard, prints = shard[order], prints[order]
    distinct, name = np.unique(prints, return_inverse=True)
    forest = Forest(len(distinct))
    for query, node in BkForest(prints, shard).links(radius):
        forest.join(name[query], name[node])
    tied = np.flatnonzero(forest.label != np.arange(len(distinct)))
    yield as_rows(LINKS, a=distinct[tied].view(np.int64), b=distinct[forest.label[tied]].view(np.int64))


def near_links(prints: DataFrame, radius: int = 3, pieces: int | None = None) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within the radius; prints: one column of distinct fingerprints.

    pieces: by default radius + 1, more once there are many fingerprints, so that shards stay small.
    A task holds the shards that it is dealt, about ``DEALT`` rows: tasks grow in number with the fingerprints.
    """
    spark = prints.sparkSession
    many = prints.count()
    if pieces is None:
        pieces = radius + 1 + (many > 1 << 23) + (many > 1 << 30)
    masks = shard_masks(radius, pieces)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many * len(masks) // DEALT))
    shards = F.array(*[F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint"))) for i, m in enumerate(masks)])
    rows = prints.select("print", F.explode(shards).alias("shard"))
    return rows.repartition(tasks, "shard").mapInArrow(functools.partial(_shard_links, radius=radius), "a bigint, b bigint")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, pieces: int | None = None) -> DataFrame:
    """(doc_id, print, component_id) of every row: the least doc_id of all documents that links reach."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("print"), radius, pieces), "near-links")
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = rooted.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")

