"""A streaming run: micro-batches of records through pages, handler, policy, sinks and checkpoints.

Spark's offset log is the position carried from batch to batch; the checkpoint table that
the run keeps is for readers and for starting elsewhere.  One active query per checkpoint
location stands for leases.  Effects are at least once; dead letters carry stable keys.

Folders below ``out``, each with one folder per batch (``epoch=<n>``), which a batch that
runs again replaces: ``outcomes`` (records with outcome), ``dlq`` and ``published`` (dead
letters and what became of them), ``saves`` (the checkpoint log), ``state`` (per shard what
is not saved yet) and ``metrics`` (counters with tags).

The count towards ``checkpoint_every`` goes on from batch to batch.  With a source of
``marks`` (see ``sources.records``), a shard that reaches its tip is saved and one that ends
gets its end mark; without, each batch counts as its shards' tip.  While a run drains, no
end mark is written: it is kept and written by the next run.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seqnum
from ..model import SEND_TO_DLQ, SHARD_END, AlreadyStarted, Closed, DrainTimeout, EngineError, HandlerFailed, HandlerOptions, HeartbeatStale, PublishFailed, ShardSyncStale, StreamConfig
from ..operators import checkpoints, failures, handlers, metrics, paging
from ..session import exists

log = logging.getLogger("tideline.run")
STATE = "shard_id string, held long, last_seq string, ended boolean"


class Watch(threading.Thread):
    """Calls ``beat`` every ``interval`` seconds; once the last success is ``most`` seconds old, gives ``stale`` and ends."""

    def __init__(self, beat: Callable[[], None], interval: float, most: float, stale: Callable[[float, BaseException | None], None]):
        super().__init__(daemon=True)
        self.beat, self.interval, self.most, self.stale = beat, interval, most, stale
        self.success, self.failures, self.error, self.stopped = time.monotonic(), 0, None, threading.Event()

    def age(self) -> float:
        return time.monotonic() - self.success

    def run(self) -> None:
        while not self.stopped.is_set():
            try:
                self.beat()
                self.success, self.error = time.monotonic(), None
            except Exception as e:  # counted; only its age decides
                self.failures, self.error = self.failures + 1, e
                log.warning("%s failed: %s", self.beat, e)
            if self.age() >= self.most:
                self.stale(self.age(), self.error)
                return
            self.stopped.wait(self.interval)


class Run:
    """Builds, starts once, watches and stops a streaming query over ``records``.

    ``publisher`` takes dead letters, ``reporter`` each batch's counters as rows, and
    ``heartbeat`` and ``sync`` are called in their intervals; a run whose heartbeat or shard
    listing has failed for too long stops with an error.
    """

    def __init__(self, records: DataFrame, config: StreamConfig, options: HandlerOptions, out: str, on_record=None, on_batch=None, sleep=time.sleep, publisher=None, reporter=None, heartbeat=None, sync=None, marks: bool = False):
        handlers.one_handler(on_record, on_batch)
        self.records, self.config, self.options, self.out = records, config, options, out.rstrip("/")
        self.on_record, self.on_batch, self.sleep, self.publisher, self.reporter, self.marks = on_record, on_batch, sleep, publisher, reporter, marks
        self.query, self.closed, self.draining, self.failure = None, False, False, None
        self.batches, self.rows, self.last = 0, 0, -1
        self.created, self.started, self.batch_ended = time.monotonic(), None, None
        t = options.tuning
        beat = t.heartbeat_interval_ms / 1000
        self.watches = {}
        if heartbeat:
            self.watches["heartbeat"] = Watch(heartbeat, beat, t.heartbeat_ttl_ms / 1000 - beat, lambda age, e: self._fail(HeartbeatStale(f"no heartbeat for {age:.1f} s: {e}")))
        if sync:
            self.watches["sync"] = Watch(sync, t.shard_sync_interval, t.max_staleness, lambda age, e: self._fail(ShardSyncStale(f"no shard listing for {age:.1f} s: {e}")))

    # -------------------------------------------------------------- a batch

    def _keep(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        path = f"{self.out}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _state(self, spark: SparkSession, before: int) -> DataFrame:
        """What the last batch before this one left."""
        if not exists(spark, f"{self.out}/state"):
            return spark.createDataFrame([], STATE)
        rows = spark.read.option("basePath", f"{self.out}/state").schema(f"{STATE}, epoch int").parquet(f"{self.out}/state")
        last = rows.filter(F.col("epoch") < before).agg(F.max("epoch")).first()[0]
        return rows.filter(F.col("epoch") == (last if last is not None else -1)).drop("epoch")

    def _publish(self, rows: DataFrame, epoch: int) -> tuple[DataFrame, str | None]:
        """Outcomes after dead letters were written and published: those of a page from the first failed one on count as failed."""
        c = self.config
        poison = failures.poison_records(rows, self.options, c.consumer_group, c.name, c.stream_arn or None, F.col("error"), datetime.now(timezone.utc))
        poison = self._keep(poison, "dlq", epoch)
        if self.publisher is None:
            return rows, None
        t = self.options.tuning
        answered = handlers.publish(poison, self.publisher, t.publish_max_attempts, t.publish_backoff, t.publish_timeout, self.sleep)
        answered = self._keep(answered, "published", epoch)
        lost = answered.filter("publish_error is not null").join(poison.select("idempotency_key", "shard_id", "sequence_number", "error"), "idempotency_key")
        one = lost.select("shard_id", "sequence_number", "error", "publish_error").orderBy("shard_id", F.length("sequence_number"), "sequence_number").first()
        if one is None:
            return rows, None
        marked = rows.join(lost.select("shard_id", "sequence_number", F.lit(True).alias("_lost")), ["shard_id", "sequence_number"], "left")
        first = F.min(F.when(F.col("_lost"), F.col("page_no"))).over(Window.partitionBy("shard_id"))
        marked = marked.withColumn("_first", first)
        outcome = F.when(F.col("page_no") == F.col("_first"), "failed").when(F.col("page_no") > F.col("_first"), "unread").otherwise(F.col("outcome"))
        return marked.withColumn("outcome", outcome).drop("_lost", "_first"), f"shard {one.shard_id}, record {one.sequence_number}: {one.error}; its dead letter was not published: {one.publish_error}"

    def _batch(self, df: DataFrame, epoch: int) -> None:
        df = df.persist(StorageLevel.DISK_ONLY)
        try:
            self._run_batch(df, epoch)
        finally:
            df.unpersist()

    def _run_batch(self, df: DataFrame, epoch: int) -> None:
        spark, t, draining = df.sparkSession, self.options.tuning, self.draining
        is_end, is_tip = F.col("sequence_number").startswith(SHARD_END), F.col("sequence_number") == "TIP"
        data, marks = (df.filter(~is_end & ~is_tip), df.filter(is_end | is_tip)) if self.marks else (df, df.filter("false"))
        done = handlers.run_handler(paging.paginate(data, t.batch_size), self.options, self.on_record, self.on_batch, self.sleep, raises=False)
        rows = self._keep(done, "outcomes", epoch)
        error = None
        if self.options.effective_policy == SEND_TO_DLQ:
            rows, text = self._publish(rows, epoch)
            error = PublishFailed(text) if text else None
        else:
            one = rows.filter("outcome = 'failed'").select("shard_id", "sequence_number", "error").orderBy("shard_id", F.length("sequence_number"), "sequence_number").first()
            error = HandlerFailed(f"shard {one.shard_id}, record {one.sequence_number}: {one.error}") if one else None
        before = self._state(spark, epoch)
        walked = checkpoints.due_pages(failures.progress(rows, self.options), t.checkpoint_every, before)
        state, saves = self._advance(walked, marks, rows, before, draining)
        saves = self._keep(saves.withColumn("epoch", F.lit(epoch)), "saves", epoch)
        self._keep(state, "state", epoch)
        tags = {"stream": self.config.name, "consumer_group": self.config.consumer_group, "handler": self.options.kind, "policy": self.options.policy}
        counters = self._keep(metrics.tagged(metrics.shard_counters(rows, saves), tags), "metrics", epoch)
        if epoch != self.last:  # a batch that runs again counts once
            self.batches, self.rows, self.last = self.batches + 1, self.rows + rows.count(), epoch
        self.batch_ended = time.monotonic()
        if self.reporter:
            for row in counters.collect():  # a few for each shard
                self.reporter(row)
        log.info("batch %d: %d records so far", epoch, self.rows)
        if error:
            log.error("batch %d: %s", epoch, error)
            raise error

    def _advance(self, walked: DataFrame, marks: DataFrame, rows: DataFrame, before: DataFrame, draining: bool) -> tuple[DataFrame, DataFrame]:
        """The new state of each shard, and the saves of the batch."""
        here = walked.filter("last").select("shard_id", F.col("held").alias("held_now"), F.col("last_seq").alias("seq_now"), "page_no", "due")
        stopped = rows.filter("outcome in ('failed', 'unread')").select("shard_id", F.lit(True).alias("stopped")).distinct()
        marked = marks.groupBy("shard_id").agg(F.lit(True).alias("tip"), F.bool_or(F.col("sequence_number").startswith(SHARD_END)).alias("ends"), F.max(seqnum.end_sequence(F.col("sequence_number"))).alias("end_seq"))
        s = before.join(here, "shard_id", "full").join(marked, "shard_id", "full").join(stopped, "shard_id", "left")
        no = lambda c: F.coalesce(F.col(c), F.lit(False))
        held, seq = F.coalesce("held_now", "held", F.lit(0)), F.coalesce("seq_now", "last_seq")
        tip = ~no("stopped") & (no("tip") if self.marks else F.col("page_no").isNotNull())
        ended = ~no("stopped") & (no("ends") | no("ended"))
        s = s.select(
            "shard_id", held.alias("held"), seq.alias("last_seq"), (tip & (held > 0)).alias("flush"), ended.alias("ends"), F.coalesce("page_no", F.lit(0)).alias("page_no"),
            F.coalesce(seq, F.when(no("ends") & ~F.col("end_seq").isin("", "TIP"), F.col("end_seq"))).alias("end_seq"),
        )
        s = s.persist(StorageLevel.DISK_ONLY)
        ident = F.lit(self.config.identity).alias("identity")
        due = checkpoints.saves_of_walked(walked, self.config.identity)
        flushed = s.filter("flush").select(ident, "shard_id", (F.col("page_no") * 2).cast("int").alias("arrival_index"), F.col("last_seq").alias("value"))
        saves = due.unionByName(flushed)
        if not draining:
            saves = saves.unionByName(s.filter("ends").select(ident, "shard_id", (F.col("page_no") * 2 + 1).cast("int").alias("arrival_index"), seqnum.end_mark(F.col("end_seq")).alias("value")))
        left = s.withColumn("held", F.when(F.col("flush"), 0).otherwise(F.col("held")).cast("long"))
        state = left.filter(~F.col("ends") | F.lit(draining)).select("shard_id", "held", F.coalesce("last_seq", "end_seq").alias("last_seq"), F.col("ends").alias("ended"))
        return state, saves

    # -------------------------------------------------------------- life

    def start(self, location: str, available_now: bool = False):
        if self.closed:
            raise Closed("the run is closed")
        if self.query is not None:
            raise AlreadyStarted("a run starts once")
        writer = self.records.writeStream.foreachBatch(self._batch).option("checkpointLocation", location)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{self.options.tuning.poll_interval} seconds"}
        self.query, self.started = writer.trigger(**trigger).start(), time.monotonic()
        for w in self.watches.values():
            w.start()
        log.info("run %s started", self.config.identity)
        return self.query

    def _fail(self, error: EngineError) -> None:
        self.failure = error
        log.error("run %s stops: %s", self.config.identity, error)
        self.close()

    def wait(self, timeout: float | None = None) -> None:
        """Until the query ends; raises what ended it."""
        self.query.awaitTermination(timeout)
        if self.failure:
            raise self.failure

    def drain(self, timeout: float = 30.0) -> None:
        """Lets the batch that runs end, saves what is not saved yet, and stops."""
        self.draining, began = True, time.monotonic()
        busy = lambda: self.query.isActive and self.query.status["isTriggerActive"]
        while busy() and time.monotonic() - began < timeout:
            time.sleep(0.05)
        late = busy()
        self.close()
        if late:
            raise DrainTimeout(f"a batch was still running after {timeout} s")
        if self.failure is None and self.query.exception() is None:
            self.flush()
        log.info("run %s drained", self.config.identity)

    def flush(self) -> None:
        """Saves each shard's position that no save covers yet."""
        spark, epoch = self.records.sparkSession, max(self.last, 0)
        state = [r.asDict() for r in self._state(spark, epoch + 1).collect()]  # one row per shard
        pending = [r for r in state if r["held"] and r["last_seq"]]
        if pending:
            rows = [(self.config.identity, r["shard_id"], 1 << 30, r["last_seq"], epoch) for r in pending]
            spark.createDataFrame(rows, "identity string, shard_id string, arrival_index int, value string, epoch int").write.mode("overwrite").parquet(f"{self.out}/saves/epoch={epoch}-drain")
            left = [(r["shard_id"], 0, r["last_seq"], r["ended"]) for r in state]
            self._keep(spark.createDataFrame(left, STATE), "state", epoch)

    def close(self) -> None:
        self.closed = True
        for w in self.watches.values():
            w.stopped.set()
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def health(self) -> dict:
        """State, batches and rows so far, the last error, and seconds since the start, the last batch, heartbeat and sync."""
        since = lambda at: None if at is None else time.monotonic() - at
        error = self.failure or (self.query.exception() if self.query is not None else None)
        state = ("closed" if self.closed else "new") if self.query is None else "running" if self.query.isActive else "stopped"
        out = {"state": state, "batches": self.batches, "rows": self.rows, "error": str(error) if error else None, "draining": self.draining, "seconds_running": since(self.started), "seconds_since_batch": since(self.batch_ended)}
        return out | {f"seconds_since_{name}": w.age() for name, w in self.watches.items()} | {f"{name}_failures": w.failures for name, w in self.watches.items()}

    def stored(self, spark: SparkSession) -> DataFrame:
        """The checkpoint table after all batches so far."""
        saves = spark.read.option("recursiveFileLookup", "true").parquet(f"{self.out}/saves")
        ordered = saves.withColumn("arrival_index", F.col("epoch").cast("long") * (1 << 32) + F.col("arrival_index"))
        return checkpoints.merge_saves(ordered.select("identity", "shard_id", "arrival_index", "value"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Extension: events per window and type with a watermark, batch or streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))


def distinct_by_key(poison: DataFrame, late: str = "1 hour") -> DataFrame:
    """Extension: dead letters delivered again within ``late`` are dropped."""
    return poison.withWatermark("failed_at", late).dropDuplicatesWithinWatermark(["idempotency_key"])
