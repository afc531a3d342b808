"""A regularised quadratic discriminant over transformed document statistics.

Every whole text gives a row of statistics (shares of kinds of characters and
words, lengths, repetition), made roughly normal by logarithms.  For each class
the model has a mean and a covariance that is shrunk towards the pooled one and
towards its own mean variance; a score is the difference of the two Gaussian
log-densities, each from the Mahalanobis distance by the cached Cholesky factor, less an
offset.  The offset stands in the place of the log of the prior shares: it is the cut with the
fewest errors on the rows learnt from, since labels need not have the shares of the corpus.

The fit takes at most ``max_rows`` labelled rows (those with the least hashes of
their doc_id: a fixed choice, not one by order); everything else covers all rows.
Rows of the held-out fold, crc32(doc_id as text) mod 3 = 1, are never learnt from.
Inputs of a score are the text's statistics alone.

Null texts count as empty; an empty text has a score as any other; null doc_ids
are not held out; repeated rows are scored alike; labels that are null or of
unknown documents count for nothing; without rows of both classes the fit raises.
Very long texts are measured in full; a score of exactly 0.5 predicts 1; an empty
table gives an empty table; columns are carried whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .blocks import Block, as_rows, blocks_of, numbered, renamed, slices_of, word_spans

FEATURES = ("words", "word_bytes", "upper", "digits", "points", "commas", "marks", "symbols", "pipes", "high", "lines", "distinct_words", "repeated_lines", "capital_words", "odd_ends", "short_words", "line_bytes", "pairs", "same_bytes", "links")


def _table(*kinds: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    for k in kinds:
        found[list(k)] = True
    return found


LETTERS, UPPER, DIGITS = _table(bytes(range(65, 91)), bytes(range(97, 123))), _table(bytes(range(65, 91))), _table(b"0123456789")
SYMBOLS = _table(b"#$%&*+/<=>@[\\]^_`{}~")
HIGH = np.arange(256) >= 128


def statistics(block: Block) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = block.data, block.offsets

    def shares(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))

    rows = block.rows
    size = np.diff(offsets)
    starts, ends, counts = word_spans(block)
    row = np.repeat(np.arange(rows), counts)
    words = np.maximum(counts, 1)
    letters = shares(LETTERS[data])
    coded = slices_of(data, starts, ends).dictionary_encode()
    codes, kinds = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    per_row = lambda mask: np.bincount(row[mask], minlength=rows)
    distinct = np.bincount(_once(row * kinds + codes) // kinds, minlength=rows)
    follow = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pair = (codes[:-1] * 1_000_003 + codes[1:])[follow] if len(row) else codes
    pair_rows = row[1:][follow] if len(row) else row
    hashed = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)
    pairs = np.bincount(_once(pair_rows.astype(np.int64) << 40 | hashed) >> 40, minlength=rows)
    length = ends - starts
    last = data[ends - 1] if len(ends) else data[:0]
    upper_total = np.concatenate([[0], np.cumsum(UPPER[data], dtype=np.int64)])
    shout = (upper_total[ends] - upper_total[starts]) * 2 > np.maximum(length, 2)
    newline = data == 10
    # Lines: spans between line ends; the bytes of lines that stood before in the same text.
    edge = np.concatenate([[True], newline[:-1]]) if len(data) else newline
    edge = edge.copy()
    inner = offsets[:-1]
    edge[inner[inner < len(data)]] = True
    line = np.flatnonzero(edge & ~newline)
    line_row = np.searchsorted(offsets, line, side="right") - 1
    stops = np.append(np.flatnonzero(newline), len(data))
    stop = np.minimum(stops[np.searchsorted(stops, line)], offsets[line_row + 1]) if len(line) else line
    lines = slices_of(data, line, stop).dictionary_encode()
    line_codes = lines.indices.to_numpy().astype(np.int64)
    _, first = np.unique(line_row * max(len(lines.dictionary), 1) + line_codes, return_index=True)
    line_bytes = np.bincount(line_row, stop - line, rows)
    fresh = np.bincount(line_row[first], (stop - line)[first], rows)
    same = shares(np.concatenate([[False], data[1:] == data[:-1]]) if len(data) else newline)
    some = np.maximum(size, 1)
    return np.stack(
        [
            np.log1p(counts),
            np.log1p(np.bincount(row, length, rows) / words),
            _logit(shares(UPPER[data]), letters),
            _logit(shares(DIGITS[data]), size),
            _logit(shares(data == 46), counts),
            _logit(shares(data == 44), counts),
            _logit(shares((data == 33) | (data == 63)), counts),
            _logit(shares(SYMBOLS[data]), size),
            _logit(shares(data == 124), counts),
            _logit(shares(HIGH[data]), size),
            np.log1p(shares(newline) / words * 100),
            _logit(distinct, counts),
            _logit(line_bytes - fresh, line_bytes),
            _logit(per_row(shout), counts),
            _logit(per_row(SYMBOLS[last] | (last == 33)), counts),
            _logit(per_row(length <= 3), counts),
            np.log1p(line_bytes / np.maximum(np.bincount(line_row, minlength=rows), 1)),
            _logit(pairs, counts),
            _logit(same, some),
            _logit(shares(data == 58), counts),
        ],
        axis=1,
    )


def _once(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, in order."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, smoothed by half an occurrence."""
    part = np.minimum(part, whole)
    return np.log((part + 0.5) / (whole - part + 0.5))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-densities' constants of the classes 0 and 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    temper: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        density = [self.constants[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x) * self.temper, -500, 500)))


def discriminant(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 0.05, temper: float = 0.1) -> Discriminant:
    """Fits the classes y in (0, 1); shrink: towards the pooled covariance; ridge: towards the mean variance; temper: keeps scores from saturating, the sign stays."""
    if not (y == 0).any() or not (y == 1).any():
        raise ValueError("labelled rows of both classes are needed")
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / scale, -12, 12)
    means = np.stack([z[y == k].mean(axis=0) for k in (0, 1)])
    apart = [z[y == k] - means[k] for k in (0, 1)]
    pooled = sum(d.T @ d for d in apart) / len(z)
    factors, constants = [], []
    for k, d in enumerate(apart):
        cov = (1 - shrink) * (d.T @ d) / len(d) + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(-np.log(np.diag(lower)).sum())
    model = Discriminant(centre, scale, means, np.stack(factors), np.array(constants), temper)
    # The classes' prior: the offset with the fewest errors on the rows learnt from, in the middle of its gap.
    apart = model.difference(x)
    order = np.argsort(apart, kind="stable")
    wrong = np.concatenate([[(y == 0).sum()], (y == 0).sum() + np.cumsum(np.where(y[order] == 1, 1, -1))])
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[apart.min() - 1], apart[order], [apart.max() + 1]])
    cut = np.mean([(edges[i] + edges[i + 1]) / 2 for i in best])
    model.constants[0] += cut
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measured(batches):
    schema = pa.schema([("quality", pa.int64()), ("stats", pa.list_(pa.float64()))])
    for batch in batches:
        for block in blocks_of(batch.column(1)):
            stats = statistics(block)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(block.rows + 1, dtype=np.int32) * stats.shape[1]), pa.array(stats.ravel()))
            yield as_rows(schema, quality=batch.column(0).slice(block.first, block.rows), stats=lists)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **how) -> Discriminant:
    """Learns from at most max_rows labelled documents outside the held-out fold."""
    known = renamed(labels, doc_id, label).select(F.col(doc_id).cast("bigint").alias(doc_id), F.col(label).cast("bigint").alias("quality"))
    known = known.dropna().filter(~held_out(doc_id)).groupBy(doc_id).agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64(doc_id), doc_id).limit(max_rows)
    texts = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint").alias(doc_id), F.col(text).cast("string").alias(text))
    rows = texts.join(F.broadcast(known), doc_id).select("quality", text).mapInArrow(_measured, StructType([StructField("quality", LongType()), StructField("stats", ArrayType(DoubleType()))]))
    # Repeated rows of a labelled document would pass the bound; the cut is by content, so it is the same each time.
    found = rows.orderBy(F.xxhash64("stats", "quality")).limit(max_rows).toArrow()
    x = found.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return discriminant(x, found.column("quality").to_numpy(), **how)


def score(docs: DataFrame, model: Discriminant, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score (0 to 1, higher: label 1 likelier) and a prediction (1 if it is 0.5 or more, else 0) under the names given.

    Columns of docs that bear those names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    plain = numbered(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    schema, at = to_arrow_schema(result), names.index(text)

    def scored(batches):
        for batch in batches:
            for block in blocks_of(batch.column(at)):
                rows = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.score(statistics(block)))], schema=schema)

    found = plain.mapInArrow(scored, result)
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in (score, predicted)]
    return found.select(*kept, F.col("score").alias(score), (F.col("score") >= 0.5).cast("int").alias(predicted))
