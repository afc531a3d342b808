"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame, each by one operator of this subpackage.

All but the last return the columns of docs, whatever further ones there are and however they
are named.  Null texts count as empty, and stay null where a row stays; repeated rows and rows
without a doc_id are rows like others; very long texts are read in full; ties go as the
operators say; an empty table gives an empty table (the classifier needs labelled rows of both
classes to learn from, and raises where an input with rows has none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from .blocks import numbered
from .queries import _path, _table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; the others go.

    An empty text is scored as any other; an empty table is returned as it is, without a model.
    """
    from . import quality

    if docs.isEmpty():
        return docs
    names = docs.columns
    text = f"c{names.index('text')}"
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    good = quality.score(numbered(docs), model, text).filter("predicted = 1")
    return good.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, whose five-word shingles have Jaccard similarity 0.8 or more: the one with the smallest doc_id.

    Texts without words are copies of each other; rows without a doc_id all stay; rows that repeat a
    doc_id with unlike texts are judged each by its own.
    """
    from . import likeness

    return likeness.representatives(reachable(spark) and docs, shingle=5, least=0.8)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages (windows of 35 words).

    Where some are cut, the rest is joined by single spaces and n_chars follows, and a document of
    which nothing is left goes; the others, null and empty texts among them, stay as they are.
    """
    from . import substrings

    names = docs.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    marked = numbered(docs).withColumn("no_text", F.col(place["text"]).isNull())
    keep = tuple(c for c in marked.columns if c not in (place["doc_id"], place["text"]))
    cut = substrings.cut(marked, place["doc_id"], place["text"], keep=keep, whole=True).filter("n_removed = 0 or n_words > n_removed")
    new = {"text": F.when(~F.col("no_text"), F.col("kept"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(place["n_chars"]))
    return cut.select(*[new.get(n, F.col(place[n])).alias(place[n]) for n in names]).toDF(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece of a document.

    An empty or null text is a piece of its end token alone; repeated rows each have their pieces.
    """
    from . import packing

    return packing.pack(docs, _path())
