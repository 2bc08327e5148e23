"""Shard lineage: which shards may be read, given their parents' completion.

Coordination tables are small next to records, but nothing is broadcast by hint: Spark
checks the size of each side itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seqnum


def list_shards(shards: DataFrame) -> DataFrame:
    """The listing without rows that have no id."""
    return shards.filter(F.coalesce("shard_id", F.lit("")) != "")


def edges(shards: DataFrame) -> DataFrame:
    """shard_id and parent_id: up to two parents each, empty ones dropped."""
    parents = F.array_compact(F.array(F.nullif(F.col("parent_shard_id"), F.lit("")), F.nullif(F.col("adjacent_parent_shard_id"), F.lit(""))))
    return shards.select("shard_id", F.explode(parents).alias("parent_id")).distinct()


def merge_known(known: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` over ``known`` by id; both have ``listing_no``, of which the last wins."""
    rows = list_shards(known.unionByName(listed))
    value = F.struct(*[F.col(c) for c in rows.columns if c != "shard_id"])
    last = rows.groupBy("shard_id").agg(F.max_by(value, "listing_no").alias("v"))
    return last.select("shard_id", *[F.col(f"v.{c}").alias(c) for c in rows.columns if c != "shard_id"])


def completed(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter(seqnum.is_end(F.col("checkpoint"))).select("shard_id").distinct()


def blocked(shards: DataFrame, done: DataFrame) -> DataFrame:
    """Shards with a parent that is known and not complete; an unknown parent doesn't block."""
    known = shards.select(F.col("shard_id").alias("parent_id"))
    open_parents = known.join(done.select(F.col("shard_id").alias("parent_id")), "parent_id", "left_anti")
    return edges(shards).join(open_parents, "parent_id", "left_semi").select("shard_id").distinct()


def ready(shards: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """shard_id of all shards to read: not complete, no parent in the way."""
    listed, done = list_shards(shards), completed(checkpoints)
    return listed.select("shard_id").distinct().join(done, "shard_id", "left_anti").join(blocked(listed, done), "shard_id", "left_anti")


def with_known_parent(shards: DataFrame) -> DataFrame:
    """Shards ever listed together with a parent; ``listing_no`` tells listings apart, if there is one."""
    by = [c for c in ("listing_no",) if c in shards.columns]
    parents = F.array_compact(F.array(F.nullif(F.col("parent_shard_id"), F.lit("")), F.nullif(F.col("adjacent_parent_shard_id"), F.lit(""))))
    pairs = shards.select(*by, "shard_id", F.explode(parents).alias("parent_id"))
    known = shards.select(*by, F.col("shard_id").alias("parent_id")).distinct()
    return pairs.join(known, [*by, "parent_id"], "left_semi").select("shard_id").distinct()


def prune(known: DataFrame, listed: DataFrame, running: DataFrame) -> DataFrame:
    """Known shards that are still listed or still run here; an empty listing prunes nothing."""
    none_listed = listed.agg((F.count("*") == 0).alias("_none"))  # one row
    all_known = known.select("shard_id", F.lit(True).alias("_none")).join(none_listed, "_none", "left_semi").select("shard_id")
    kept = listed.select("shard_id").union(running.select("shard_id")).union(all_known)
    return known.join(kept.distinct(), "shard_id", "left_semi")


def prune_completions(done: DataFrame, kept: DataFrame) -> DataFrame:
    """Completion entries of kept shards, and those that a kept shard still names as a parent."""
    named = kept.select("shard_id").union(edges(kept).select("parent_id"))
    return done.join(named.distinct(), "shard_id", "left_semi")
