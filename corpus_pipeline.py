"""A training corpus from ``documents``: five stages, each one operator of ``tideline.llm``.

1. ``language``: documents whose language is rejected go.
2. ``near_duplicates``: of each class of near duplicates the document of the least doc_id stays.
3. ``decontamination``: documents with a passage of ``benchmark`` go.
4. ``mixture``: whole documents, as often as the mix to the sources' target weights takes them.
5. ``token_output``: token ids in files; one row per document of the mix, as read back.

A stage takes the Parquet that the one before wrote; all but the last return the columns
of ``documents``.  Null and empty texts go in the first stage (they have no language); an
empty table stays empty through all stages.  A document that the mix takes more than once
has as many rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, langid, mixing, neardup, tokens
from tideline.llm.common import Scratch, table
from tideline.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, Scratch(spark, "pipeline-neardup"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, Scratch(spark, "pipeline-mix"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    written = tokens.write_tokens(docs, Scratch(spark, "pipeline-tokens"), tokenizer_path())
    return tokens.crc_of_ids(tokens.stream_starts(written))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
