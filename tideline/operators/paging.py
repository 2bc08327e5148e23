"""Pages: bounded slices of a shard's records in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order() -> list[Column]:
    """A shard's order: sequence numbers by length, then by characters."""
    return [F.length("sequence_number"), F.col("sequence_number")]


def paginate(records: DataFrame, batch_size: int = 100) -> DataFrame:
    """With ``ordinal`` (0-based in the shard) and ``page_no``.

    One sort by shard, which later windows and groups on the shard reuse.
    """
    ordinal = F.row_number().over(Window.partitionBy("shard_id").orderBy(*order())) - 1
    return records.withColumn("ordinal", ordinal).withColumn("page_no", F.floor(F.col("ordinal") / batch_size).cast("int"))


def bound(records: DataFrame, per_shard: int) -> DataFrame:
    """At most so many records of each shard: the read limit of one pass.

    Spark keeps only these while it sorts each partition, before and after the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("shard_id").orderBy(*order()))
    return records.withColumn("_rank", rank).filter(F.col("_rank") <= per_shard).drop("_rank")


def summarize(pages: DataFrame) -> DataFrame:
    """shard_id, page_no, n, first_seq and last_seq of each page."""
    key = F.struct(F.length("sequence_number").alias("n"), F.col("sequence_number").alias("s"))
    by = pages.groupBy("shard_id", "page_no").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return by.select("shard_id", "page_no", "n", F.col("lo.s").alias("first_seq"), F.col("hi.s").alias("last_seq"))


def ends_shard(next_iterator: Column, has_page: Column) -> Column:
    """A page without a next iterator closes its shard; no page doesn't."""
    return has_page & (F.coalesce(next_iterator, F.lit("")) == "")
