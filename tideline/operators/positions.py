"""Where reading starts, what is replayed after a crash, and how far reading is behind."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seqnum
from ..model import AFTER_SEQUENCE, AT_TIMESTAMP, LATEST
from . import lineage


def start_positions(shards: DataFrame, checkpoints: DataFrame, start: str = LATEST, at: datetime | None = None) -> DataFrame:
    """shard_id, position, sequence_number and start_timestamp of each shard.

    Completed shards have position ``COMPLETED``.  A checkpoint is resumed after; a shard
    without one starts at its beginning if it was listed with a parent, and at ``start``
    otherwise.
    """
    listed = lineage.list_shards(shards).select("shard_id").distinct()
    child = lineage.with_known_parent(shards).withColumn("child", F.lit(True))
    rows = listed.join(checkpoints.select("shard_id", "checkpoint"), "shard_id", "left").join(child, "shard_id", "left")
    cp = F.col("checkpoint")
    has = F.coalesce(cp, F.lit("")) != ""
    position = F.when(seqnum.is_end(cp), "COMPLETED").when(has, AFTER_SEQUENCE).when(F.col("child"), "TRIM_HORIZON").otherwise(F.lit(start or LATEST))
    return rows.select(
        "shard_id", position.alias("position"), F.when(has & ~seqnum.is_end(cp), cp).alias("sequence_number"),
        F.when(position == AT_TIMESTAMP, F.lit(at).cast("timestamp")).alias("start_timestamp"),
    )


def read_from(records: DataFrame, positions: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """The records that lie after each shard's position; ``tips`` (shard_id, tip) anchors LATEST.

    Without tips, LATEST reads nothing of what is there already.
    """
    p = positions.withColumnsRenamed({"sequence_number": "_after"})
    rows = records.join(p, "shard_id")
    latest = F.lit(False)
    if tips is not None:
        rows = rows.join(tips.select("shard_id", F.col("tip").alias("_tip")), "shard_id", "left")
        latest = (F.col("position") == LATEST) & seqnum.after(F.col("sequence_number"), F.col("_tip"))
    wanted = (
        (F.col("position") == "TRIM_HORIZON")
        | ((F.col("position") == AFTER_SEQUENCE) & seqnum.after(F.col("sequence_number"), F.col("_after")))
        | ((F.col("position") == AT_TIMESTAMP) & (F.col("approximate_arrival_timestamp") >= F.col("start_timestamp")))
        | latest
    )
    return rows.filter(wanted).select(*records.columns)


def replay_set(records: DataFrame, checkpoints: DataFrame, frontier: DataFrame) -> DataFrame:
    """Records delivered again after a crash: after the checkpoint, up to the processed frontier (shard_id, frontier)."""
    rows = records.join(frontier, "shard_id").join(checkpoints.select("shard_id", "checkpoint"), "shard_id", "left")
    seq, done = F.col("sequence_number"), seqnum.is_end(F.col("checkpoint"))
    return rows.filter(~done & seqnum.after(seq, F.col("checkpoint")) & ~seqnum.after(seq, F.col("frontier"))).select(*records.columns)


def lag(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """shard_id, behind (records after the checkpoint) and millis_behind_latest (from its arrival to the last arrival)."""
    rows = records.join(checkpoints.select("shard_id", "checkpoint"), "shard_id", "left")
    ahead = seqnum.after(F.col("sequence_number"), seqnum.end_sequence(F.col("checkpoint")))
    arrival = F.unix_millis("approximate_arrival_timestamp")
    by = rows.groupBy("shard_id").agg(F.count_if(ahead).alias("behind"), F.max(arrival).alias("last"), F.max(F.when(~ahead, arrival)).alias("read"), F.min(arrival).alias("first"))
    return by.select("shard_id", "behind", (F.col("last") - F.coalesce("read", "first")).alias("millis_behind_latest"))
