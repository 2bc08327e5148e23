"""Metrics: emissions from tables of outcomes, the statsd line format, and roll-ups."""

from __future__ import annotations

import logging
import socket
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("tideline.metrics")

# Names that dashboards rely on.
PREFIX = "kinesis_consumer."
COUNTERS = (
    "records_processed", "pages_fetched", "records_skipped", "dlq_records_published", "handler_retries", "checkpoints_saved", "checkpoint_failures", "get_records_failures",
    "lease_acquired", "lease_released", "lease_release_failures", "lease_renewals", "lease_renewal_failures", "lease_lost", "heartbeat_failures", "rebalance_moves",
    "rebalance_skips", "rebalance_pass_failures", "shard_sync_failures", "shards_completed", "worker_starts", "worker_stops", "worker_deregistered",
)
GAUGES = ("owned_shards", "active_workers", "fair_share_low", "fair_share_high", "millis_behind_latest")
TIMINGS = ("handler_duration", "get_records_duration", "checkpoint_save_duration", "lease_acquire_duration", "rebalance_pass_duration", "drain_duration")
TAGS = ("stream", "consumer_group", "shard", "handler", "policy", "kind", "outcome")


def plain_number(value: Column) -> Column:
    """A double without exponent or needless zeros."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.9f", value), "0+$", ""), r"\.$", "")
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(text)


def clean_tag(text: Column) -> Column:
    return F.translate(text, ",|#\n\r", "_____")


def statsd_line(name: Column, kind: Column, value: Column, tags: Column) -> Column:
    """name:value|type, and |#key:value,... if there are tags; timings are in milliseconds."""
    pairs = F.transform(tags, lambda t: F.concat(clean_tag(t["key"]), F.lit(":"), clean_tag(t["value"])))
    suffix = F.when(F.size(tags) > 0, F.concat(F.lit("|#"), F.array_join(pairs, ","))).otherwise(F.lit(""))
    return F.concat(name, F.lit(":"), plain_number(value), F.lit("|"), kind, suffix)


class StatsdReporter:
    """Sends emissions (name, type, value, tags) as UDP datagrams, one line each; a ``reporter`` of runs.  Lost ones are lost."""

    def __init__(self, host: str = "127.0.0.1", port: int = 8125):
        self.address, self.socket = (host, port), socket.socket(socket.AF_INET, socket.SOCK_DGRAM)

    def line(self, row) -> str:
        value = format(Decimal(repr(float(row.value))), "f")
        value = value.rstrip("0").rstrip(".") if "." in value else value
        clean = str.maketrans(",|#\n\r", "_____")
        tags = ",".join(f"{k.translate(clean)}:{v.translate(clean)}" for k, v in (row.tags or {}).items())
        return f"{row.name}:{value}|{row.type}" + (f"|#{tags}" if tags else "")

    def __call__(self, row) -> None:
        try:
            self.socket.sendto(self.line(row).encode(), self.address)
        except OSError as e:
            log.debug("metric not sent: %s", e)


def shard_counters(outcomes: DataFrame, saves: DataFrame) -> DataFrame:
    """name, shard_id and value of the counters of a run."""
    by = outcomes.groupBy("shard_id").agg(
        F.count_if(F.col("outcome") == "processed").alias("records_processed"), F.count_if(F.col("outcome") == "skipped").alias("records_skipped"), F.count_if(F.col("outcome") == "dlq").alias("dlq_records_published"),
        F.sum(F.when(F.col("outcome") != "unread", F.col("attempts") - 1)).alias("handler_retries"), F.count_distinct(F.when(F.col("outcome") != "unread", F.col("page_no"))).alias("pages_fetched"),
    )
    saved = saves.groupBy("shard_id").agg(F.count("*").alias("checkpoints_saved"))
    wide = by.join(saved, "shard_id", "left").withColumn("checkpoints_saved", F.coalesce("checkpoints_saved", F.lit(0)))
    names = ["records_processed", "records_skipped", "dlq_records_published", "handler_retries", "pages_fetched", "checkpoints_saved"]
    long = wide.unpivot("shard_id", [F.col(n).cast("long").alias(n) for n in names], "name", "value")
    return long.select(F.concat(F.lit(PREFIX), "name").alias("name"), "shard_id", "value")


def tagged(counters: DataFrame, tags: dict[str, str], *by: str) -> DataFrame:
    """name, type, value and tags of counters (name, shard_id, value, and the columns ``by``); zeros are not emitted.

    Each emission has the tags of the stream, its shard if it has one, and the columns ``by`` as tags of their names.
    """
    pairs = [F.lit(x) for pair in tags.items() for x in pair]
    for tag, c in (("shard", "shard_id"), *((b, b) for b in by)):
        pairs += [F.lit(tag), F.col(c)]
    every = F.create_map(*pairs)
    return counters.filter("value <> 0").select("name", F.lit("c").alias("type"), F.col("value").cast("double").alias("value"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("tags"))


def _named(rows: DataFrame, name: Column) -> DataFrame:
    """name, shard_id and value: how many rows have each name; rows without one count for nothing."""
    named = rows.select(F.concat(F.lit(PREFIX), name).alias("name"), "shard_id", *[c for c in ("kind", "outcome") if c in rows.columns]).filter("name is not null")
    return named.groupBy(named.columns).agg(F.count("*").alias("value"))


def lease_counters(results: DataFrame) -> DataFrame:
    """Counters of lease operations that took effect or not (op, shard_id, ok; ``error`` if the store failed).

    A release of a lease that is not held any more is a lease lost, not a failure; so is a renewal.
    """
    op, ok, error = F.col("op"), F.col("ok"), F.col("error").isNotNull()
    got = F.when(op.isin("acquire", "claim") & ok & ~error, "lease_acquired")
    got = got.when((op == "renew") & error, "lease_renewal_failures").when((op == "renew") & ok, "lease_renewals").when((op == "release") & error, "lease_release_failures")
    got = got.when((op == "release") & ok, "lease_released").when(op.isin("renew", "release") & ~ok, "lease_lost")
    return _named(results, got)


def rebalance_counters(executed: DataFrame) -> DataFrame:
    """Counters of a pass's actions by ``kind``: acquire, claim or shed."""
    kinds = F.when(F.col("kind") == "acquire_unowned", "acquire").when(F.col("kind") == "claim_donor", "claim").otherwise(F.col("kind"))
    return _named(executed.withColumn("kind", kinds), F.when(F.col("result") == "moved", "rebalance_moves").otherwise("rebalance_skips"))


def event_counters(events: DataFrame) -> DataFrame:
    """Counters of a log of events (event, shard_id, ok, kind, outcome): reads, saves, beats, passes, syncs, shards' ends, workers' lives.

    A failed read has its error's class as ``kind``; a worker that stopped has ``outcome`` clean or error.
    """
    e, ok = F.col("event"), F.col("ok")
    got = F.when((e == "read") & ok, "pages_fetched").when(e == "read", "get_records_failures").when((e == "save") & ok, "checkpoints_saved").when(e == "save", "checkpoint_failures")
    for event, name in (("heartbeat", "heartbeat_failures"), ("rebalance", "rebalance_pass_failures"), ("sync", "shard_sync_failures")):
        got = got.when((e == event) & ~ok, name)
    for event, name in (("shard_end", "shards_completed"), ("worker_start", "worker_starts"), ("worker_stop", "worker_stops"), ("deregister", "worker_deregistered")):
        got = got.when((e == event) & ok, name)
    return _named(events, got)


def timings(spans: DataFrame) -> DataFrame:
    """name, type, value (milliseconds) and shard_id of spans (span, shard_id, began, ended)."""
    names = F.when(F.col("span") == "handler", "handler_duration").when(F.col("span") == "read", "get_records_duration").when(F.col("span") == "save", "checkpoint_save_duration")
    names = names.when(F.col("span") == "acquire", "lease_acquire_duration").when(F.col("span") == "rebalance", "rebalance_pass_duration").when(F.col("span") == "drain", "drain_duration")
    took = (F.unix_micros("ended") - F.unix_micros("began")) / 1000
    return spans.select(F.concat(F.lit(PREFIX), names).alias("name"), F.lit("ms").alias("type"), took.alias("value"), "shard_id").filter("name is not null")


def lag_gauges(lags: DataFrame) -> DataFrame:
    """name, shard_id and value: how far each shard is behind."""
    return lags.select(F.lit(PREFIX + "millis_behind_latest").alias("name"), "shard_id", F.col("millis_behind_latest").cast("double").alias("value"))


def ownership_gauges(shares: DataFrame) -> DataFrame:
    """name and value; with no ready shard the shares are 0."""
    names = {"owned_shards": "owned", "active_workers": "active_workers", "fair_share_low": "low", "fair_share_high": "high"}
    long = shares.select(*[F.col(c).cast("double").alias(n) for n, c in names.items()]).unpivot([], list(names), "name", "value")
    return long.select(F.concat(F.lit(PREFIX), "name").alias("name"), "value")


def rollup(emissions: DataFrame, interval: str = "10 seconds") -> DataFrame:
    """Per window, name and tags: count, sum, lower, upper, mean, median, stddev and percentiles."""
    by = emissions.groupBy(F.window("ts", interval).start.alias("window_start"), "name", "tag")
    v = F.col("value")
    pct = {f"p{int(q * 100)}": F.percentile("value", F.lit(q)) for q in (0.5, 0.9, 0.95, 0.99)}
    return by.agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("lower"), F.max(v).alias("upper"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), *[c.alias(n) for n, c in pct.items()]
    )


def last_value(emissions: DataFrame, *by: str) -> DataFrame:
    return emissions.groupBy(*by).agg(F.max_by("value", "ts").alias("last_value"))


def mean_over_time(emissions: DataFrame, step: str = "1 minute") -> DataFrame:
    """bucket and mean_value for every step between the first and the last, null where nothing was emitted."""
    means = emissions.groupBy(F.window("ts", step).start.alias("bucket")).agg(F.avg("value").alias("mean_value"))
    ends = means.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("bucket"))
    return spine.join(means, "bucket", "left")


def measurements(emissions: DataFrame, pattern: str) -> DataFrame:
    return emissions.filter(F.col("name").rlike(pattern)).select("name").distinct()


def tag_values(emissions: DataFrame, key: str) -> DataFrame:
    return emissions.select(F.col("tags")[key].alias("tag_value")).filter("tag_value is not null").distinct()
