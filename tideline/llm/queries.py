"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, brown, decontaminate, langid, mixing, neardup, preference, quality, sharding, tokens
from .common import Scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    written = tokens.write_tokens(table(spark, sf_dir, "documents"), scratch, tokenizer_path())
    return tokens.crc_of_ids(tokens.stream_starts(written))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op5"))


def op6_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.store_features(table(spark, sf_dir, "documents"), Scratch(spark, "op6")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op7")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op9")
    return preference.format_pairs(preference.swapped_replies(table(spark, sf_dir, "conversations"), scratch), scratch)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return found.select("doc_id", "class_id", "class_size")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_decontaminate, op3_class_lm, op4_feistel_shards, op5_quality, op6_audio_media, op7_mix_sources, op8_language_id, op9_preference, op10_near_duplicates)
}
ORACLE_SQL: dict[str, str] = {"op9_preference": preference.SWAPPED_SQL}
