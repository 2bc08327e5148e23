"""Outcomes under a failure policy, and dead-letter rows, from pages of records.

``succeeds_on`` tells the attempt on which a record's handler succeeds (null: never).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..model import BATCH, FAIL_FAST, RECORD, SEND_TO_DLQ, SKIP, HandlerOptions
from .paging import order

def of_page():
    return Window.partitionBy("shard_id", "page_no")


def outcomes(pages: DataFrame, options: HandlerOptions) -> DataFrame:
    """With ``attempts`` and ``outcome``: processed, skipped, dlq, failed, or unread after a failure.

    A batch handler sees a page as a whole: it succeeds when the slowest of its records does.
    Pages are then dealt to tasks one by one, and sorted once: in the tasks of their shards,
    each window over pages would keep another sort of the whole shard in memory.
    """
    most = options.tuning.retry_max_attempts
    on = F.coalesce(F.col("succeeds_on"), F.lit(1 << 30))
    if options.kind == BATCH:
        pages = pages.repartition("shard_id", "page_no").sortWithinPartitions("shard_id", "page_no", *order())
        on = F.max(on).over(of_page())
    failed = {SKIP: "skipped", SEND_TO_DLQ: "dlq", FAIL_FAST: "failed"}[options.effective_policy]
    on, pages = F.col("_on"), pages.withColumn("_on", on)  # one window, though it is used twice
    out = pages.withColumn("attempts", F.least(on, F.lit(most)).cast("int")).withColumn("outcome", F.when(on <= most, "processed").otherwise(failed)).drop("_on")
    if failed != "failed":
        return out
    # the first failure of a shard stops it: what follows is not read
    place = F.col("page_no" if options.kind == BATCH else "ordinal")
    first = F.min(F.when(F.col("outcome") == "failed", place)).over(Window.partitionBy("shard_id"))
    return out.withColumn("outcome", F.when(place > first, "unread").otherwise(F.col("outcome")))


def skipped_ranges(outcome_rows: DataFrame) -> DataFrame:
    """shard_id, n, first_seq and last_seq of what was skipped, page by page."""
    key = F.struct(F.length("sequence_number").alias("n"), F.col("sequence_number").alias("s"))
    lost = outcome_rows.filter("outcome = 'skipped'").groupBy("shard_id", "page_no")
    by = lost.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return by.select("shard_id", "page_no", "n", F.col("lo.s").alias("first_seq"), F.col("hi.s").alias("last_seq"))


def poison_records(outcome_rows: DataFrame, options: HandlerOptions, group: str, stream: str, arn: str | None, error: Column, failed_at: datetime) -> DataFrame:
    """The 16 columns of dead-lettered records.

    A batch handler's failure takes the whole page; the index counts within it.  The key is
    the same for every delivery of a record.
    """
    batch = options.kind == BATCH
    index = F.row_number().over(of_page().orderBy(*order())) - 1
    rows = outcome_rows.filter("outcome = 'dlq'")
    if batch:
        rows = rows.withColumn("_index", index).withColumn("_size", F.count("*").over(of_page()))
    else:
        rows = rows.withColumn("_index", F.lit(0)).withColumn("_size", F.lit(1))
    handler = F.lit(BATCH if batch else RECORD)
    return rows.select(
        keys.idempotency_key(F.lit(group), F.lit(stream), F.col("shard_id"), F.col("sequence_number"), handler).alias("idempotency_key"),
        F.lit(None if arn else stream).cast("string").alias("stream_name"), F.lit(arn).cast("string").alias("stream_arn"), F.lit(group).alias("consumer_group"), "shard_id", "sequence_number", "partition_key",
        "approximate_arrival_timestamp", F.col("data").alias("payload"), error.alias("error"), handler.alias("handler"), "attempts", F.lit(failed_at).cast("timestamp").alias("failed_at"),
        F.col("_size").cast("int").alias("batch_size"), F.col("_index").cast("int").alias("record_index_in_batch"), F.col("_index").cast("int").alias("record_sequence_in_batch_order"),
    )


def dedupe(poison: DataFrame) -> DataFrame:
    """One row for each key: a page that failed after some were published is published again."""
    return poison.dropDuplicates(["idempotency_key"])


def progress(outcome_rows: DataFrame, options: HandlerOptions) -> DataFrame:
    """Per page what a checkpoint may cover: n handled, last_seq, and ``flush`` (a dead letter was published).

    Pages from the first failure on are not covered at all.
    """
    key = F.struct(F.length("sequence_number").alias("n"), F.col("sequence_number").alias("s"))
    by = outcome_rows.groupBy("shard_id", "page_no").agg(
        F.count("*").alias("n"), F.max(key).alias("hi"), F.max(F.col("outcome") == "dlq").alias("flush"), F.max(F.col("outcome").isin("failed", "unread")).alias("stopped")
    )
    return by.filter("not stopped").select("shard_id", "page_no", "n", F.col("hi.s").alias("last_seq"), "flush")
