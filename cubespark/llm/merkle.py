"""Merkle trees over sections and paragraphs, with SQL functions only.

A text is sections (parted by an empty line) of paragraphs (parted by line ends);
a paragraph is spans of up to 64 code points, whose digests are the leaves.  A
paragraph's digest is that of its leaves' digests, a section's that of its
paragraphs', the root's that of the sections'.  Equal roots mean equal texts, and
where roots differ, the branches that differ say which sections and paragraphs
were edited.  A fingerprint is the root and the leaves in order, each leaf cut to
its first 8 digits (the root is made of whole digests); likeness is the share that the
distinct cut leaves of two fingerprints have in common.

``with_next`` gives every row the next one's text without one sort of all.  Rows are
dealt to groups by the quantiles of their keys, about ``GROUP`` rows each (a doc_id that
more rows repeat than a group has is divided by a hash of the text), and a copy of each
group's first row goes to the group before it, so that every next row is found within a
group: texts move once, and besides only one row a group.

Null texts count as empty (a tree of one empty paragraph: no leaves; two such
texts are alike, 1.0).  Rows without a doc_id come after no document: nothing
takes the place of their tail, and they are like no next document.  Rows that
repeat a doc_id follow each other in the order of their texts' hashes (rows that are the
same throughout stay in one group, whose window spills).  Very long texts
are read in full.  An empty table gives an empty table; extra columns stay out.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import renamed

SPAN, CUT = 64, 8
#: Rows of a group, about, and how many groups there may be.
GROUP, MOST_GROUPS = 1 << 16, 1 << 14


def tree(text: Column) -> Column:
    """Leaves by section and paragraph: array<array<array<string>>>."""
    spans = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0)), lambda b: F.md5(b))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), spans))


def paragraph_digests(of: Column) -> Column:
    return F.transform(of, lambda s: F.transform(s, lambda p: F.md5(F.array_join(p, ""))))


def root(paragraphs: Column) -> Column:
    """The root above paragraph digests."""
    return F.md5(F.array_join(F.transform(paragraphs, lambda s: F.md5(F.array_join(s, ""))), ""))


def cut_leaves(of: Column) -> Column:
    return F.transform(F.flatten(F.flatten(of)), lambda x: F.substring(x, 1, CUT))


def fingerprint(paragraphs: Column, leaves: Column) -> Column:
    """The root and the cut leaves, as one string."""
    return F.concat(root(paragraphs), F.lit(":"), F.array_join(leaves, ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct leaves of two leaf arrays over all of theirs; 1 if both have none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def differing(left: Column, right: Column) -> Column:
    """Places (section, paragraph, from 0) at which the paragraph digests of two trees differ, the longer one's rest included."""
    most = lambda x, y: F.greatest(F.size(x), F.size(y))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    part = lambda x, i: F.coalesce(F.get(x, i), F.array().cast("array<string>"))
    places = F.transform(
        upto(most(left, right)),
        lambda i: F.transform(
            F.filter(upto(most(part(left, i), part(right, i))), lambda j: ~F.get(part(left, i), j).eqNullSafe(F.get(part(right, i), j))),
            lambda j: F.struct(i.alias("section"), j.alias("paragraph")),
        ),
    )
    return F.flatten(places)


def bounds_of(rows: DataFrame, groups: int) -> list[tuple[int, int]]:
    """Keys (doc_id, hash) that part the rows in about so many groups, in order: each is the last of its group.

    A doc_id that is several quantiles at once has so many groups of its own, by even parts of the hashes.
    """
    if groups < 2:
        return []
    found = rows.agg(F.percentile_approx("doc_id", [i / groups for i in range(1, groups)], 20 * groups).alias("q")).first()["q"] or []
    out = []
    for doc_id, n in sorted(Counter(found).items()):
        out += [(doc_id, (1 << 64) * k // n - (1 << 63) - 1) for k in range(1, n + 1)]
    return out


def group_of(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are below a row's key, by bisection."""
    if not bounds:
        return F.lit(0)
    ids, hashes = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        there = F.get(ids, at + step - 1)
        return F.when((there < F.col("doc_id")) | (there == F.col("doc_id")) & (F.get(hashes, at + step - 1) < F.col("hash")), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in descending order, of the first after the last."""
    rows = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = rows.filter("doc_id is not null")
    # Several groups for each task, so that tasks that are dealt them by hash have about as many.
    groups = min(MOST_GROUPS, max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // group)))
    bounds = bounds_of(known.select("doc_id"), groups)
    keyed = known.withColumn("hash", F.xxhash64("text")).withColumn("g", group_of(bounds))
    # The first row of a group goes to the group of greater keys too, that of the last group to the first one:
    # a row for each group, so few that they are broadcast.
    heads = keyed.groupBy("g").agg(F.max(F.struct("doc_id", "hash")).alias("head"))
    upward = Window.orderBy("g")
    to = F.coalesce(F.lead("g").over(upward), F.min("g").over(Window.partitionBy()))
    sent = heads.select(F.col("head.doc_id").alias("doc_id"), F.col("head.hash").alias("hash"), to.alias("to"))
    own = F.struct(F.col("g"), F.lit(False).alias("copy"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("g"), F.lit(True).alias("copy"))))
    dealt = keyed.join(F.broadcast(sent), ["doc_id", "hash"], "left").select("doc_id", "hash", "text", F.explode(places).alias("at"))
    order = Window.partitionBy("at.g").orderBy("at.copy", F.desc("doc_id"), F.desc("hash"), F.desc("text"))
    found = dealt.withColumn("next_text", F.lead("text").over(order)).filter("not at.copy").select("doc_id", "text", "next_text")
    return found.unionByName(rows.filter("doc_id is null").withColumn("next_text", F.lit(None).cast("string")))


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document, its edited text (its last third replaced from the next document's start), fingerprints, likenesses, and the branches that tell the edit."""
    pairs = with_next(docs, doc_id, text).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    made = pairs.select("doc_id", "n_chars", edited.alias("edited"), tree(F.col("text")).alias("tree"), tree(edited).alias("edited_tree"), cut_leaves(tree(F.col("next_text"))).alias("nexts"))
    below = made.select("doc_id", "n_chars", "edited", "nexts", paragraph_digests(F.col("tree")).alias("old"), paragraph_digests(F.col("edited_tree")).alias("new"), cut_leaves(F.col("tree")).alias("own"), cut_leaves(F.col("edited_tree")).alias("theirs"))
    own, theirs, nexts = (F.array_distinct(F.col(c)) for c in ("own", "theirs", "nexts"))
    return below.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("old"), F.col("own")).alias("fingerprint"),
        fingerprint(F.col("new"), F.col("theirs")).alias("edited_fingerprint"),
        own.alias("own"),
        theirs.alias("theirs"),
        nexts.alias("nexts"),
        differing(F.col("old"), F.col("new")).alias("differing"),
    ).select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own"), F.col("theirs")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("nexts")), F.lit(0.0)).alias("near_next"),
        "differing",
    )
