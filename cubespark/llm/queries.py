"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from . import oracles

TOKENIZER = "byte_bpe_50k.json"


def _path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    encoded = bpe.encode(_table(spark, sf_dir, "documents"), _path())
    return bpe.decode(encoded, _path()).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_merkle_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    found = merkle.edits(_table(spark, sf_dir, "documents"))
    first = F.get("differing", 0)
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.round("near_edited", 9).alias("near_edited"),
        F.round("near_next", 9).alias("near_next"),
        F.size("differing").cast("bigint").alias("n_differing"),
        F.concat_ws("/", first["section"], first["paragraph"]).alias("first_differing"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), _path())


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.scan(_table(spark, sf_dir, "documents"))


def op4_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import transducer

    counted = transducer.count_tokens(_table(spark, sf_dir, "documents"), _path())
    return counted.select("*", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    found = media.read_media(media.write_media(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", F.sha2("samples", 256).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op6_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.cut(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_warc_normaliser,
        op3_licence_digests,
        op4_transducer_counts,
        op5_lossless_webp,
        op6_simhash_bk_trees,
        op7_quadratic_discriminant,
        op8_difference_cover_dedup,
        op9_merkle_trees,
        op10_best_fit_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_warc_normaliser": oracles.WARC, "op3_licence_digests": oracles.licence_sql(), "op8_difference_cover_dedup": oracles.REPEATS, "op9_merkle_trees": oracles.merkle_sql()}
