"""Near copies by SimHash links and MinHash bands, each link checked by the Jaccard similarity of whole shingle sets.

Sets: the shingles of ``shingle`` words that ``simhash`` takes (A-Z lower-cased; a
text with fewer words has its whole sequence as the one shingle), as 64-bit hashes.
Equal sets are one *node*, whatever the number of copies; texts without words share
the empty set.  A node's name is 64 bits of its set, so that among 10**9 different sets
two have one name with a chance of 0.03.

Candidates come in *buckets*.  The classes of SimHash fingerprints over the same
shingles (``simhash.near_links``: BK-trees, ``radius`` bits) are one kind.  They alone
cannot give right results: two sets of similarity 0.8 are about 10 of 64 bits apart, and
no search for so many bits stays near linear.  So the bands of MinHash signatures are the
other kind: 128 minima make 32 bands of 4, and two sets of similarity s share no band with
probability (1 - s^4)^32, 5e-8 at 0.8, less above.  Of buckets with the very same members
one is kept.

In a bucket a set is compared with those that hold one of its rarest shingles (sets of
similarity ``least`` or more must share one of those), and a set that is already joined to
the bucket's component is not compared again, so that a large group of near copies costs no
row for each of its pairs.

A bucket of more than ``MOST`` sets is cut in slots by hash.  First each slot is compared in
itself; then one set of every component that a bucket has, which joins what the slots found
apart; and where a bucket still has several components, the sets of all but its largest go to
every slot, that one's to their own.  So two sets of a bucket that are not joined yet meet in
some slot, a group of near copies costs each of its sets a constant number of rows, and no task
holds more than about a slot and the strays of one bucket.  A link is a pair whose Jaccard similarity, counted on the whole
sets, is ``least`` or more; components of links by alternating stars.

Null doc_ids have a row and join others like any; repeated rows each have a row; very long
texts are sets of all their shingles; a similarity of just ``least`` links; an empty table
gives an empty table; other columns are carried whatever their names.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, as_rows, blocks_of, numbered, ragged, stored
from .components import components
from .simhash import LINKS, Forest, block_prints, near_links
from .substrings import Words

BANDS, DEPTH = 32, 4
_RANDOM = np.random.default_rng(42)
MASKS = _RANDOM.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32)
FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32) | np.uint32(1)
SALTS = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)

#: Sets of a bucket that one task may hold, and rows (a set in a bucket) that a task is dealt, about.
MOST, DEALT = 1024, 40_000

SIGNS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("print", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])


def block_sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): row i of the block has the distinct shingles hashes[bounds[i]:bounds[i + 1]], in order."""
    lower = block.data + ((block.data >= 65) & (block.data <= 90)) * np.uint8(32)
    words = Words(dataclasses.replace(block, data=lower))
    row_of = np.repeat(np.arange(block.rows), words.counts)
    runs = [(shingle, np.flatnonzero(words.room >= shingle))] + [(k, words.first[words.counts == k]) for k in range(1, shingle)]
    row = np.concatenate([row_of[at] for _, at in runs])
    hashes = np.concatenate([words.rolling(size, at) for size, at in runs])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return np.searchsorted(row, np.arange(block.rows + 1)), hashes


def _nodes(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    raw, at = hashes.tobytes(), (bounds * 8).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1).view(np.int64)


def band_keys(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Bucket of each band (columns) of every row that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.tile(SALTS, (len(starts), 1))
    if len(starts):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i, (mask, factor) in enumerate(zip(MASKS, FACTORS)):
            least = np.minimum.reduceat((short ^ mask) * factor, starts)
            k = (keys[:, i // DEPTH] ^ least) * np.uint64(0xBF58476D1CE4E5B9)
            keys[:, i // DEPTH] = k ^ k >> np.uint64(29)
    return keys


def _signs(batches, shingle: int):
    for batch in batches:
        for block in blocks_of(batch.column(2)):
            bounds, hashes = block_sets(block, shingle)
            keys = band_keys(bounds, hashes)
            offsets = np.concatenate([[0], np.cumsum((np.diff(bounds) > 0) * BANDS)]).astype(np.int32)
            own = batch.slice(block.first, block.rows)
            yield as_rows(SIGNS, key=own.column(0), doc_id=own.column(1), node=_nodes(bounds, hashes), print=block_prints(block, shingle).view(np.int64), bands=pa.ListArray.from_arrays(offsets, keys.ravel().view(np.int64)))


def _sets(batches, shingle: int):
    for batch in batches:
        for block in blocks_of(batch.column(0)):
            bounds, hashes = block_sets(block, shingle)
            raw, at = hashes.tobytes(), (bounds * 8).tolist()
            yield as_rows(SETS, node=_nodes(bounds, hashes), shingles=pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()))


def joined(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of similarity ``least`` or more that join the same sets as all such pairs do."""
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    tokens, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((code, often[code], owner))  # each set's shingles, rarest first
    prefix = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    some = np.arange(len(code)) - first[owner] < prefix[owner]
    rare, of = code[order][some], owner[some]
    begin = np.searchsorted(of, np.arange(len(sets) + 1))
    by = np.argsort(rare, kind="stable")
    at = np.searchsorted(rare[by], np.arange(len(tokens) + 1)).tolist()
    holders = [of[by[a:b]] for a, b in zip(at, at[1:])]
    waiting, mark, out = np.ones(len(sets), bool), np.zeros(len(tokens), bool), []
    for seed in range(len(sets)):
        open_ = [seed] if waiting[seed] else []
        waiting[seed] = False
        while open_:
            one = open_.pop()
            met = []
            for t in rare[begin[one] : begin[one + 1]].tolist():
                if len(holders[t]):
                    holders[t] = holders[t][waiting[holders[t]]]
                    met.append(holders[t])
            other = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            if not len(other):
                continue
            own = code[first[one] : first[one] + sizes[one]]
            mark[own] = True
            both = np.add.reduceat(mark[ragged(code, first[other], sizes[other])], np.cumsum(sizes[other]) - sizes[other], dtype=np.int64)
            mark[own] = False
            found = other[both / (sizes[one] + sizes[other] - both) >= least].tolist()
            waiting[found] = False
            open_ += found
            out += [(one, x) for x in found]
    return out


def _links(batches, least: float):
    """Links of every slot of a bucket that the task is dealt; a slot's rows lie side by side."""
    held, sets, now = [], [], None

    def found():
        distinct, first = np.unique(np.array(held, np.int64), return_index=True)
        pairs = joined([np.frombuffer(sets[i], np.uint64) for i in first.tolist()], least) if len(distinct) > 1 else []
        return as_rows(LINKS, a=distinct[[x for x, _ in pairs]], b=distinct[[y for _, y in pairs]]) if pairs else None

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("bucket", "slot", "node", "shingles")]
        for *at, node, shingles in zip(*columns):
            if at != now:
                if held and (links := found()) is not None:
                    yield links
                held, sets, now = [], [], at
            held.append(node)
            sets.append(shingles)
    if held and (links := found()) is not None:
        yield links


def buckets_of(nodes: DataFrame, radius: int) -> DataFrame:
    """(bucket, node, n): of all buckets of two nodes or more one for each set of members, with their number."""
    roots = components(near_links(nodes.select("print").distinct(), radius), "print-links")
    classed = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select("node", F.xxhash64(F.lit("class"), F.coalesce("root", "print")).alias("bucket"))
    every = nodes.select("node", F.explode("bands").alias("bucket")).unionByName(classed)
    told = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
    kept = told.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return every.join(kept, "bucket")


def _slot(node: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(2)), F.ceil(n / MOST)).cast("int")


def _compared(slots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links within the slots (bucket, slot, node), written to the shared folder."""
    slots = stored(slots, "slots")
    tasks = max(int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots.count() // DEALT))
    sent = slots.join(sets, "node").select("bucket", "slot", "node", "shingles")
    dealt = sent.repartition(tasks, "bucket", "slot").sortWithinPartitions("bucket", "slot")
    return stored(dealt.mapInArrow(functools.partial(_links, least=least), "a bigint, b bigint"), "likeness-links")


def likeness_links(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the same nodes as all pairs of a bucket with similarity ``least`` do.

    met: (bucket, node, n) of every member; sets: (node, shingles); both read several times.
    """
    links = _compared(met.select("bucket", _slot("node", F.col("n")).alias("slot"), "node"), sets, least)
    large = met.filter(F.col("n") > MOST)
    if large.isEmpty():
        return links

    def rooted() -> DataFrame:
        return large.join(components(links, "slot-links"), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))

    heads = rooted().groupBy("bucket", "root").agg(F.min("node").alias("node"))
    many = heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    links = links.unionByName(_compared(heads.join(many, "bucket").select("bucket", _slot("node", F.col("m")).alias("slot"), "node"), sets, least))
    now = stored(rooted(), "rooted")
    sizes = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    first = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.count(F.lit(1)).alias("apart")).filter("apart > 1").drop("apart")
    own, last = _slot("node", F.col("n")), F.ceil(F.col("n") / MOST).cast("int") - 1
    every = F.when(F.col("root") == F.col("largest"), F.array(own)).otherwise(F.sequence(F.lit(0), last))
    return links.unionByName(_compared(now.join(first, "bucket").select("bucket", F.explode(every).alias("slot"), "node"), sets, least))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """The rows of docs, one of each component: that with its least doc_id.

    Of rows that repeat that doc_id and its text one stays (any, if they differ elsewhere); rows that
    repeat the doc_id with another text are judged by their own text.  Rows without a doc_id all
    stay, since no component can name them.
    """
    names = docs.columns
    at, words = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    plain = numbered(docs).withColumn("key", F.xxhash64(F.col(words).cast("string"))).withColumn("id", F.col(at).cast("bigint"))
    source = plain.select("key", F.col("id").alias("doc_id"), F.col(words).cast("string").alias("text"))
    signs = source.mapInArrow(functools.partial(_signs, shingle=shingle), "key bigint, doc_id bigint, node bigint, print bigint, bands array<bigint>")
    # A node's first row: that with the least doc_id, one without a doc_id only if it has no other.
    first = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key")
    nodes = stored(signs.groupBy("node").agg(F.min(first).alias("first"), F.any_value("print").alias("print"), F.any_value("bands").alias("bands")), "nodes")
    met = stored(buckets_of(nodes, radius), "met")
    asked = nodes.join(met.select("node").distinct(), "node", "left_semi").select("first.key", "first.doc_id")
    texts = source.join(asked, (source["key"] == asked["key"]) & source["doc_id"].eqNullSafe(asked["doc_id"]), "left_semi").select("text")
    sets = stored(texts.mapInArrow(functools.partial(_sets, shingle=shingle), "node bigint, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    roots = components(likeness_links(met, sets, least), "likeness-links")
    rooted = nodes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).filter("not first.lost").select("first.key", F.col("first.doc_id").alias("id"))
    kept = plain.join(chosen, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    own = [f"c{i}" for i in range(len(names))]
    return kept.select(*own).unionByName(plain.filter("id is null").select(*own)).toDF(*names)
