"""All registered queries of the record-stream engine and, beside each, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arn, keys, retry, seqnum
from ..model import AT_TIMESTAMP, BATCH, LATEST, RECORD, SEND_TO_DLQ, SHARD_END, SKIP, TRIM_HORIZON, HandlerOptions, StreamConfig, Tuning
from ..operators import checkpoints, failures, handlers, leases, leasing, lineage, metrics, ownership, paging, positions
from ..session import shared_folder
from ..sources import records as source
from ..streaming import run as streaming
from .fixtures import NOW, cte, frame, timed

FLAGSHIP = "checkpoint_after_run"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_TIME = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
IDENTITY, GROUP, STREAM = "workers:events", "workers", "events"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; a handler succeeds on attempt 1, 2 or 3, and never on poison."""
    r = source.from_events(spark, sf_dir)
    on = (F.col("sequence_number").cast("long") - 1) % 3 + 1
    return r.withColumn("succeeds_on", F.when(~F.col("poison"), on).cast("int"))


REC = """rec AS (SELECT 'shardId-' || lpad(CAST(user_id % 4 AS VARCHAR), 12, '0') AS shard_id, CAST(event_id + 1 AS VARCHAR) AS sequence_number,
  CAST(user_id AS VARCHAR) AS partition_key, props, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 3 + 1 END AS succeeds_on FROM events)"""
PG = REC + """, pg AS (SELECT *, CAST(floor(ordinal / 100) AS INTEGER) AS page_no FROM
  (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY length(sequence_number), sequence_number) - 1 AS ordinal FROM rec))"""


def outcome_sql(kind: str, failed: str, most: int = 3) -> str:
    on = "coalesce(succeeds_on, 1000000)" if kind == RECORD else "max(coalesce(succeeds_on, 1000000)) OVER (PARTITION BY shard_id, page_no)"
    base = f"{PG}, o AS (SELECT *, CAST(least(at_, {most}) AS INTEGER) AS attempts, CASE WHEN at_ <= {most} THEN 'processed' ELSE '{failed}' END AS outcome FROM (SELECT *, {on} AS at_ FROM pg))"
    return base


def options(kind: str, policy: str, publisher: bool = True, **tuning) -> HandlerOptions:
    return HandlerOptions(kind, policy, publisher, Tuning(**tuning))


def outcome_rows(spark: SparkSession, sf_dir: str, o: HandlerOptions) -> DataFrame:
    return failures.outcomes(paging.paginate(model_records(spark, sf_dir), o.tuning.batch_size), o)


RECORD_DLQ, BATCH_DLQ = options(RECORD, SEND_TO_DLQ), options(BATCH, SEND_TO_DLQ, batch_size=10)
RECORD_SKIP, BATCH_SKIP = options(RECORD, SKIP), options(BATCH, SKIP, batch_size=10)

# ------------------------------------------------------------------ the flagship: pages, outcomes, cadence, checkpoint

FOLD = """p AS (SELECT shard_id, page_no, count(*) AS n, arg_max(sequence_number, (length(sequence_number), sequence_number)) AS last_seq, bool_or(outcome = 'dlq') AS flush FROM o GROUP BY ALL),
f AS (SELECT shard_id, page_no, n, last_seq, flush OR n >= {every} AS due, CASE WHEN flush OR n >= {every} THEN 0 ELSE n END AS held FROM p WHERE page_no = 0
  UNION ALL SELECT p.shard_id, p.page_no, p.n, p.last_seq, p.flush OR f.held + p.n >= {every}, CASE WHEN p.flush OR f.held + p.n >= {every} THEN 0 ELSE f.held + p.n END
  FROM f JOIN p ON p.shard_id = f.shard_id AND p.page_no = f.page_no + 1)"""


@query(f"""WITH RECURSIVE {outcome_sql(RECORD, 'dlq')}, {FOLD.format(every=300)}
SELECT 'workers:events' AS identity, shard_id, arg_max(last_seq, page_no) AS checkpoint FROM f WHERE due GROUP BY shard_id""")
def checkpoint_after_run(spark, sf_dir):
    progress = failures.progress(outcome_rows(spark, sf_dir, RECORD_DLQ), RECORD_DLQ)
    return checkpoints.merge_saves(checkpoints.saves_of(progress, 300, IDENTITY))


# ------------------------------------------------------------------ sources and positions


@query(f"WITH {cte('shards')} SELECT shard_id, parent_shard_id FROM fx_shards WHERE coalesce(shard_id, '') <> ''")
def list_shards(spark, sf_dir):
    return lineage.list_shards(frame(spark, "shards")).select("shard_id", "parent_shard_id")


@query(f"""WITH {cte('listings')} SELECT shard_id, parent_shard_id, adjacent_parent_shard_id, listing_no FROM
  (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY listing_no DESC) AS k FROM fx_listings) WHERE k = 1""")
def merge_known_shards(spark, sf_dir):
    t = frame(spark, "listings")
    return lineage.merge_known(t.filter("listing_no < 3"), t.filter("listing_no = 3"))


@query(f"""WITH {cte('known', 'running')} SELECT shard_id FROM fx_known WHERE shard_id IN ('a', 'n') OR shard_id IN (SELECT shard_id FROM fx_running)""")
def prune_stale_shards(spark, sf_dir):
    known = frame(spark, "known")
    return lineage.prune(known, known.filter("shard_id in ('a', 'n')"), frame(spark, "running")).select("shard_id")


@query(f"WITH {cte('known')} SELECT shard_id FROM fx_known")
def prune_with_empty_listing(spark, sf_dir):
    known = frame(spark, "known")
    return lineage.prune(known, known.filter("false"), frame(spark, "running").filter("false")).select("shard_id")


@query("SELECT shard_id FROM (VALUES ('old'), ('a')) AS v(shard_id)")
def prune_completions(spark, sf_dir):
    known = frame(spark, "known")
    done = known.filter("shard_id in ('old', 'a', 'b')").select("shard_id")
    return lineage.prune_completions(done, known.filter("shard_id in ('a', 'n')")).select("shard_id")


POSITIONS = """WITH {fx}, l AS (SELECT * FROM fx_shards WHERE coalesce(shard_id, '') <> ''),
child AS (SELECT DISTINCT s.shard_id FROM fx_shards s JOIN l p ON p.shard_id = s.parent_shard_id OR p.shard_id = s.adjacent_parent_shard_id)
SELECT l.shard_id, CASE WHEN c.checkpoint LIKE 'SHARD_END%' THEN 'COMPLETED' WHEN coalesce(c.checkpoint, '') <> '' THEN 'AFTER_SEQUENCE_NUMBER'
  WHEN l.shard_id IN (SELECT shard_id FROM child) THEN 'TRIM_HORIZON' ELSE '{start}' END AS position,
  CASE WHEN coalesce(c.checkpoint, '') <> '' AND c.checkpoint NOT LIKE 'SHARD_END%' THEN c.checkpoint END AS sequence_number
FROM l LEFT JOIN fx_checkpoints c USING (shard_id)"""


@query(POSITIONS.format(fx=cte("shards", "checkpoints"), start="LATEST"))
def start_positions(spark, sf_dir):
    return positions.start_positions(frame(spark, "shards"), frame(spark, "checkpoints")).select("shard_id", "position", "sequence_number")


@query(POSITIONS.format(fx=cte("shards", "checkpoints"), start="AT_TIMESTAMP"))
def start_positions_at_timestamp(spark, sf_dir):
    return positions.start_positions(frame(spark, "shards"), frame(spark, "checkpoints"), AT_TIMESTAMP, NOW_TIME).select("shard_id", "position", "sequence_number")


def _positions(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "shard_id string, position string, sequence_number string, start_timestamp timestamp")


def _first_shards(n: int) -> list[str]:
    return [f"shardId-{i:012d}" for i in range(n)]


@query(f"""WITH {REC} SELECT shard_id, sequence_number FROM rec WHERE shard_id <> 'shardId-000000000003'
  AND (length(sequence_number), sequence_number) > (CASE WHEN shard_id = 'shardId-000000000000' THEN 2 WHEN shard_id = 'shardId-000000000001' THEN 3 ELSE 0 END, CASE WHEN shard_id = 'shardId-000000000000' THEN '99' WHEN shard_id = 'shardId-000000000001' THEN '500' ELSE '' END)""")
def read_after_sequence(spark, sf_dir):
    a, b, c, d = _first_shards(4)
    p = _positions(spark, [(a, "AFTER_SEQUENCE_NUMBER", "99", None), (b, "AFTER_SEQUENCE_NUMBER", "500", None), (c, TRIM_HORIZON, None, None), (d, LATEST, None, None)])
    return positions.read_from(source.from_events(spark, sf_dir), p).select("shard_id", "sequence_number")


@query(f"""WITH {REC}, m AS (SELECT shard_id, to_timestamp(floor(epoch(min(ts)) / 2 + epoch(max(ts)) / 2)) AS at_, floor(epoch(min(ts)) / 2 + epoch(max(ts)) / 2) AS s FROM rec GROUP BY shard_id)
SELECT rec.shard_id, count(*) AS n FROM rec JOIN m USING (shard_id) WHERE epoch(ts) >= m.s GROUP BY rec.shard_id""")
def read_at_timestamp(spark, sf_dir):
    r = source.from_events(spark, sf_dir)
    at = F.col("approximate_arrival_timestamp").cast("double")
    middle = r.groupBy("shard_id").agg(F.floor(F.min(at) / 2 + F.max(at) / 2).cast("timestamp").alias("start_timestamp"))
    p = middle.select("shard_id", F.lit(AT_TIMESTAMP).alias("position"), F.lit(None).cast("string").alias("sequence_number"), "start_timestamp")
    return positions.read_from(r, p).groupBy("shard_id").agg(F.count("*").alias("n"))


@query(f"""WITH {REC} SELECT shard_id, sequence_number FROM rec WHERE (length(sequence_number), sequence_number) > (3, '900')""")
def read_latest_from_tip(spark, sf_dir):
    shards = _first_shards(4)
    p = _positions(spark, [(s, LATEST, None, None) for s in shards])
    tips = spark.createDataFrame([(s, "900") for s in shards], "shard_id string, tip string")
    return positions.read_from(source.from_events(spark, sf_dir), p, tips).select("shard_id", "sequence_number")


@query(f"""WITH {PG} SELECT shard_id, page_no, count(*) AS n, arg_min(sequence_number, ordinal) AS first_seq, arg_max(sequence_number, ordinal) AS last_seq FROM pg GROUP BY ALL""")
def pages_of_records(spark, sf_dir):
    return paging.summarize(paging.paginate(source.from_events(spark, sf_dir), 100))


@query(f"WITH {PG} SELECT shard_id, sequence_number FROM pg WHERE ordinal < 50")
def bounded_pass(spark, sf_dir):
    return paging.bound(source.from_events(spark, sf_dir), 50).select("shard_id", "sequence_number")


@query(f"WITH {cte('page_iterators')} SELECT page_no, coalesce(next_iterator, '') = '' AS closes FROM fx_page_iterators")
def page_ends_shard(spark, sf_dir):
    return frame(spark, "page_iterators").select("page_no", paging.ends_shard(F.col("next_iterator"), F.lit(True)).alias("closes"))


@query(f"""WITH {cte('errors')} SELECT code, fault,
  coalesce(code IN ('ProvisionedThroughputExceededException', 'LimitExceededException', 'KMSThrottlingException', 'ThrottlingException', 'InternalFailure', 'ServiceUnavailable', 'RequestTimeout') OR fault IN ('server', 'network'), false) AS retryable,
  CASE WHEN code = 'ExpiredIteratorException' THEN 'expired' WHEN code IN ('ProvisionedThroughputExceededException', 'LimitExceededException', 'KMSThrottlingException', 'ThrottlingException') THEN 'throttle' ELSE 'other' END AS kind,
  coalesce(code IN ('AccessDeniedException', 'ResourceNotFoundException', 'InvalidArgumentException', 'ValidationException') OR (fault = 'client' AND code NOT IN ('ThrottlingException', 'LimitExceededException', 'ProvisionedThroughputExceededException', 'RequestTimeout', 'RequestTimeoutException', 'ExpiredNextTokenException')), false) AS fatal
  FROM fx_errors""")
def error_classes(spark, sf_dir):
    c, f = F.col("code"), F.col("fault")
    return frame(spark, "errors").select("code", "fault", retry.retryable_read(c, f).alias("retryable"), retry.read_error_kind(c).alias("kind"), retry.fatal_sync(c, f).alias("fatal"))


@query("""SELECT n, least(10.0::DOUBLE, 0.5 * pow(2, n - 1))::DOUBLE AS read_delay, least(10.0, least(10.0, 0.5 * pow(2, n - 1)) * 1.25)::DOUBLE AS read_delay_half_jitter,
  least(20.0, least(30.0, pow(2, n - 1)))::DOUBLE AS sync_delay, (n * (n - 1) / 2)::DOUBLE AS handler_sleep, (n - 1)::DOUBLE AS store_sleep FROM (SELECT CAST(unnest(range(1, 13)) AS BIGINT) AS n)""")
def retry_delays(spark, sf_dir):
    n = F.col("n")
    read = retry.doubling(n, retry.READ_BASE, retry.READ_CAP)
    return spark.range(1, 13).withColumnRenamed("id", "n").select(
        "n", read.alias("read_delay"), retry.with_jitter(read, F.lit(0.5), F.lit(retry.READ_CAP)).alias("read_delay_half_jitter"), retry.sync_delay(n, 20.0).alias("sync_delay"),
        retry.linear_sleep(n, 1.0).cast("double").alias("handler_sleep"), retry.constant_sleep(n, 1.0).cast("double").alias("store_sleep"),
    )


@query(f"""WITH {cte('arns')} SELECT arn, CASE WHEN regexp_matches(arn, '^arn:[^:]+:kinesis:[^:]+:[0-9]{{12}}:stream/[A-Za-z0-9_.-]{{1,128}}$') THEN regexp_extract(arn, 'stream/(.*)$', 1) END AS stream_name FROM fx_arns""")
def stream_names_of_arns(spark, sf_dir):
    return frame(spark, "arns").select("arn", arn.stream_name(F.col("arn")).alias("stream_name"))


# ------------------------------------------------------------------ handlers and failures

SUMMARY = "SELECT shard_id, outcome, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM {t} GROUP BY ALL"


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard_id", "outcome").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(f"WITH {outcome_sql(RECORD, 'skipped')} " + SUMMARY.format(t="o"))
def record_handler_skip(spark, sf_dir):
    return _summary(outcome_rows(spark, sf_dir, RECORD_SKIP))


@query(f"WITH {outcome_sql(BATCH, 'skipped').replace('/ 100', '/ 10')} " + SUMMARY.format(t="o"))
def batch_handler_skip(spark, sf_dir):
    return _summary(outcome_rows(spark, sf_dir, BATCH_SKIP))


@query(f"""WITH {outcome_sql(RECORD, 'failed')}, u AS (SELECT * REPLACE (CASE WHEN ordinal > min(CASE WHEN outcome = 'failed' THEN ordinal END) OVER (PARTITION BY shard_id) THEN 'unread' ELSE outcome END AS outcome) FROM o) """ + SUMMARY.format(t="u"))
def record_handler_fail_fast(spark, sf_dir):
    return _summary(outcome_rows(spark, sf_dir, options(RECORD, "fail-fast")))


@query(ORACLE_SQL["record_handler_fail_fast"])
def dlq_without_publisher(spark, sf_dir):
    return _summary(outcome_rows(spark, sf_dir, options(RECORD, SEND_TO_DLQ, publisher=False)))


@query(f"""WITH {outcome_sql(BATCH, 'failed').replace('/ 100', '/ 10')}, u AS (SELECT * REPLACE (CASE WHEN page_no > min(CASE WHEN outcome = 'failed' THEN page_no END) OVER (PARTITION BY shard_id) THEN 'unread' ELSE outcome END AS outcome) FROM o) """ + SUMMARY.format(t="u"))
def batch_handler_fail_fast(spark, sf_dir):
    return _summary(outcome_rows(spark, sf_dir, options(BATCH, "fail-fast", batch_size=10)))


def _effect(row) -> None:
    """A handler for the event log: fails on poison."""
    if row.poison:
        raise ValueError("poison")


def _page_effect(rows) -> None:
    if any(r.poison for r in rows):
        raise ValueError("poison")


def _no_sleep(_: float) -> None: ...


@query(f"""WITH {PG} SELECT shard_id, CASE WHEN succeeds_on IS NULL THEN 'skipped' ELSE 'processed' END AS outcome, count(*) AS n, CAST(sum(CASE WHEN succeeds_on IS NULL THEN 3 ELSE 1 END) AS BIGINT) AS attempts FROM pg GROUP BY ALL""")
def record_handler_run(spark, sf_dir):
    pages = paging.paginate(source.from_events(spark, sf_dir), 100)
    return _summary(handlers.run_handler(pages, RECORD_SKIP, on_record=_effect, sleep=_no_sleep))


@query(f"""WITH {PG}, b AS (SELECT *, bool_or(succeeds_on IS NULL) OVER (PARTITION BY shard_id, page_no) AS bad FROM pg)
SELECT shard_id, CASE WHEN bad THEN 'dlq' ELSE 'processed' END AS outcome, count(*) AS n, CAST(sum(CASE WHEN bad THEN 3 ELSE 1 END) AS BIGINT) AS attempts FROM b GROUP BY ALL""".replace("/ 100", "/ 10"))
def batch_handler_run(spark, sf_dir):
    pages = paging.paginate(source.from_events(spark, sf_dir), 10)
    return _summary(handlers.run_handler(pages, BATCH_DLQ, on_batch=_page_effect, sleep=_no_sleep))


@query(f"""WITH {outcome_sql(RECORD, 'skipped')} SELECT shard_id, count(*) AS handled, CAST(sum(attempts - 1) AS BIGINT) AS retries FROM o GROUP BY shard_id""")
def handler_retries(spark, sf_dir):
    return handlers.retry_summary(outcome_rows(spark, sf_dir, RECORD_SKIP))


@query(f"""WITH {outcome_sql(RECORD, 'skipped')} SELECT shard_id, page_no, count(*) AS n, arg_min(sequence_number, ordinal) AS first_seq, arg_max(sequence_number, ordinal) AS last_seq FROM o WHERE outcome = 'skipped' GROUP BY ALL""")
def skipped_ranges(spark, sf_dir):
    return failures.skipped_ranges(outcome_rows(spark, sf_dir, RECORD_SKIP))


def key_sql(kind: str) -> str:
    fields = ["'workers'", "'events'", "shard_id", "sequence_number", f"'{kind}'"]
    framed = " || ".join(f"unhex(lpad(hex(strlen({f})), 16, '0')) || encode({f})" for f in fields)
    return f"'kcg-dlq-v1:' || sha256({framed})"


def poison_sql(kind: str, index: str, size: str) -> str:
    return f"""SELECT {key_sql(kind)} AS idempotency_key, 'events' AS stream_name, 'workers' AS consumer_group, shard_id, sequence_number, partition_key, epoch_us(ts) // 1000 AS arrived_ms, props AS payload_text,
  'failed after 3 attempts' AS error, '{kind}' AS handler, attempts, CAST({size} AS INTEGER) AS batch_size, CAST({index} AS INTEGER) AS record_index_in_batch, CAST({index} AS INTEGER) AS record_sequence_in_batch_order FROM o"""


def _poison(spark, sf_dir, o: HandlerOptions) -> DataFrame:
    error = F.concat(F.lit("failed after "), F.col("attempts").cast("string"), F.lit(" attempts"))
    return failures.poison_records(outcome_rows(spark, sf_dir, o), o, GROUP, STREAM, None, error, NOW_TIME)


def _shown(p: DataFrame) -> DataFrame:
    return p.select(
        "idempotency_key", "stream_name", "consumer_group", "shard_id", "sequence_number", "partition_key", F.unix_millis("approximate_arrival_timestamp").alias("arrived_ms"),
        F.col("payload").cast("string").alias("payload_text"), "error", "handler", "attempts", "batch_size", "record_index_in_batch", "record_sequence_in_batch_order",
    )


@query(f"WITH {outcome_sql(RECORD, 'dlq')} {poison_sql(RECORD, '0', '1')} WHERE outcome = 'dlq'")
def poison_records(spark, sf_dir):
    return _shown(_poison(spark, sf_dir, RECORD_DLQ))


@query(f"""WITH {outcome_sql(BATCH, 'dlq').replace('/ 100', '/ 10')} SELECT * FROM ({poison_sql(BATCH, 'ordinal % 10', 'count(*) OVER (PARTITION BY shard_id, page_no)')} WHERE outcome = 'dlq')""")
def poison_pages(spark, sf_dir):
    return _shown(_poison(spark, sf_dir, BATCH_DLQ))


@query(f"WITH {outcome_sql(RECORD, 'dlq')} SELECT count(*) AS n FROM o WHERE outcome = 'dlq'")
def poison_deduplicated(spark, sf_dir):
    p = _poison(spark, sf_dir, RECORD_DLQ)
    return failures.dedupe(p.unionByName(p)).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ checkpoints


@query(f"""WITH {cte('matrix')} SELECT stored, saved, CASE WHEN coalesce(saved, '') = '' THEN false WHEN coalesce(stored, '') = '' THEN true WHEN stored = saved THEN false
  WHEN stored LIKE 'SHARD_END%' THEN false WHEN saved LIKE 'SHARD_END%' THEN true ELSE (length(saved), saved) > (length(stored), stored) END AS advances FROM fx_matrix""")
def checkpoint_advances(spark, sf_dir):
    return frame(spark, "matrix").select("stored", "saved", seqnum.advances(F.col("stored"), F.col("saved")).alias("advances"))


@query(f"""WITH {cte('saves')}, s AS (SELECT * FROM fx_saves WHERE value <> '')
SELECT identity, shard_id, coalesce(arg_min(value, arrival_index) FILTER (value LIKE 'SHARD_END%'), arg_max(value, (length(value), value)) FILTER (value NOT LIKE 'SHARD_END%')) AS checkpoint FROM s GROUP BY ALL""")
def checkpoint_merge(spark, sf_dir):
    return checkpoints.merge_saves(frame(spark, "saves"))


@query(f"""WITH {cte('deleted_saves')}, d AS (SELECT identity, shard_id, max(arrival_index) AS at_ FROM fx_deleted_saves WHERE value IS NULL GROUP BY ALL),
s AS (SELECT f.* FROM fx_deleted_saves f LEFT JOIN d USING (identity, shard_id) WHERE f.value IS NOT NULL AND f.arrival_index > coalesce(at_, -1))
SELECT identity, shard_id, coalesce(arg_min(value, arrival_index) FILTER (value LIKE 'SHARD_END%'), arg_max(value, (length(value), value)) FILTER (value NOT LIKE 'SHARD_END%')) AS checkpoint FROM s GROUP BY ALL""")
def checkpoint_merge_with_deletes(spark, sf_dir):
    return checkpoints.merge_saves(frame(spark, "deleted_saves"))


@query(f"WITH {cte('stored')} SELECT checkpoint, coalesce(checkpoint LIKE 'SHARD_END%' OR regexp_full_match(checkpoint, '0|[1-9][0-9]*'), false) AS valid FROM fx_stored")
def checkpoint_validity(spark, sf_dir):
    return frame(spark, "stored").select("checkpoint", seqnum.valid_stored(F.col("checkpoint")).alias("valid"))


@query(f"""WITH RECURSIVE {outcome_sql(RECORD, 'dlq')}, {FOLD.format(every=250)} SELECT shard_id, page_no, n, last_seq, due FROM f""")
def checkpoint_cadence(spark, sf_dir):
    walked = checkpoints.due_pages(failures.progress(outcome_rows(spark, sf_dir, RECORD_DLQ), RECORD_DLQ), 250)
    return walked.select("shard_id", "page_no", "n", "last_seq", "due")


@query(f"""WITH {PG} SELECT 'workers:events' AS identity, shard_id, arg_max(sequence_number, ordinal) AS checkpoint FROM pg GROUP BY shard_id""")
def checkpoint_on_drain(spark, sf_dir):
    progress = failures.progress(outcome_rows(spark, sf_dir, RECORD_SKIP), RECORD_SKIP)
    return checkpoints.merge_saves(checkpoints.saves_of(progress, 1_000_000, IDENTITY, drained=True))


@query(f"""WITH {PG} SELECT 'workers:events' AS identity, shard_id, 'SHARD_END:' || arg_max(sequence_number, ordinal) AS checkpoint FROM pg WHERE shard_id < 'shardId-000000000002' GROUP BY shard_id""")
def checkpoint_of_closed_shards(spark, sf_dir):
    progress = failures.progress(outcome_rows(spark, sf_dir, RECORD_SKIP), RECORD_SKIP)
    closed = spark.createDataFrame([(s,) for s in _first_shards(2)], "shard_id string")
    stored = checkpoints.merge_saves(checkpoints.saves_of(progress, 1_000_000, IDENTITY, closed=closed))
    return stored.filter(seqnum.is_end(F.col("checkpoint")))  # open shards of a long log have saves too


REPLAY_STORED = [("shardId-000000000000", "99"), ("shardId-000000000001", "SHARD_END:7"), ("shardId-000000000002", "")]


@query(f"""WITH {REC} SELECT shard_id, sequence_number FROM rec WHERE shard_id <> 'shardId-000000000001' AND (length(sequence_number), sequence_number) <= (3, '500')
  AND (shard_id <> 'shardId-000000000000' OR (length(sequence_number), sequence_number) > (2, '99'))""")
def replay_after_crash(spark, sf_dir):
    stored = spark.createDataFrame(REPLAY_STORED, "shard_id string, checkpoint string")
    frontier = spark.createDataFrame([(s, "500") for s in _first_shards(4)], "shard_id string, frontier string")
    return positions.replay_set(source.from_events(spark, sf_dir), stored, frontier).select("shard_id", "sequence_number")


CARRIED = {"shardId-000000000000": 40, "shardId-000000000002": 249}


@query(f"""WITH RECURSIVE {outcome_sql(RECORD, 'skipped')}, p AS (SELECT shard_id, page_no, count(*) AS n FROM o GROUP BY ALL),
f AS (SELECT shard_id, page_no, n + c >= 250 AS due, CASE WHEN n + c >= 250 THEN 0 ELSE n + c END AS held FROM (SELECT *, CASE shard_id WHEN 'shardId-000000000000' THEN 40 WHEN 'shardId-000000000002' THEN 249 ELSE 0 END AS c FROM p WHERE page_no = 0)
  UNION ALL SELECT p.shard_id, p.page_no, f.held + p.n >= 250, CASE WHEN f.held + p.n >= 250 THEN 0 ELSE f.held + p.n END FROM f JOIN p ON p.shard_id = f.shard_id AND p.page_no = f.page_no + 1)
SELECT shard_id, page_no, due, held, page_no = max(page_no) OVER (PARTITION BY shard_id) AS last FROM f""")
def checkpoint_cadence_carried(spark, sf_dir):
    held = spark.createDataFrame(list(CARRIED.items()), "shard_id string, held long")
    walked = checkpoints.due_pages(failures.progress(outcome_rows(spark, sf_dir, RECORD_SKIP), RECORD_SKIP), 250, held)
    return walked.select("shard_id", "page_no", "due", "held", "last")


# ------------------------------------------------------------------ lineage

DONE = "done AS (SELECT shard_id FROM fx_checkpoints WHERE checkpoint LIKE 'SHARD_END%')"
EDGES = "edges AS (SELECT DISTINCT shard_id, p AS parent_id FROM (SELECT shard_id, parent_shard_id AS p FROM l UNION ALL SELECT shard_id, adjacent_parent_shard_id FROM l) WHERE coalesce(p, '') <> '')"
LINEAGE = f"WITH {cte('shards', 'checkpoints')}, l AS (SELECT * FROM fx_shards WHERE coalesce(shard_id, '') <> ''), {DONE}, {EDGES}, blocked AS (SELECT DISTINCT e.shard_id FROM edges e JOIN l p ON p.shard_id = e.parent_id WHERE e.parent_id NOT IN (SELECT shard_id FROM done))"


@query(LINEAGE + " SELECT shard_id FROM l WHERE shard_id NOT IN (SELECT shard_id FROM done) AND shard_id NOT IN (SELECT shard_id FROM blocked)")
def ready_shards(spark, sf_dir):
    return lineage.ready(frame(spark, "shards"), frame(spark, "checkpoints")).orderBy("shard_id")


@query(LINEAGE + " SELECT shard_id FROM blocked")
def blocked_shards(spark, sf_dir):
    s = lineage.list_shards(frame(spark, "shards"))
    return lineage.blocked(s, lineage.completed(frame(spark, "checkpoints")))


@query(f"WITH {cte('checkpoints')}, {DONE} SELECT shard_id FROM done")
def completed_shards(spark, sf_dir):
    return lineage.completed(frame(spark, "checkpoints"))


@query(f"""WITH {cte('listings')} SELECT DISTINCT a.shard_id FROM fx_listings a JOIN fx_listings b ON a.listing_no = b.listing_no AND (a.parent_shard_id = b.shard_id OR a.adjacent_parent_shard_id = b.shard_id)""")
def shards_with_known_parent(spark, sf_dir):
    return lineage.with_known_parent(frame(spark, "listings"))


# ------------------------------------------------------------------ leases and ownership


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', {str(ok).lower()})" for i, s, ok in [(0, "a", True), (1, "a", False), (2, "a", False), (3, "a", True), (4, "a", False), (5, "a", True), (6, "a", False), (7, "a", True), (8, "b", True), (9, "b", False), (10, "b", True), (11, "b", True), (12, "b", False)]) + ") AS v(op_index, shard_id, ok)")
def lease_operations(spark, sf_dir):
    return leases.fold(timed(frame(spark, "lease_ops"), "now")).select("op_index", "shard_id", "ok")


@query("SELECT * FROM (VALUES ('a', 'w3', '2024-05-01 12:01:10'), ('b', 'w1', '2024-05-01 12:00:14')) AS v(shard_id, owner, expires)")
def leases_after_operations(spark, sf_dir):
    left = leases.fold(timed(frame(spark, "lease_ops"), "now"), only_final=True)
    return left.select("shard_id", "owner", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("SELECT * FROM (VALUES ('w2', '2024-05-01 12:00:38')) AS v(owner, expires)")
def workers_after_operations(spark, sf_dir):
    return leases.workers(timed(frame(spark, "lease_ops"), "now")).select("owner", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query(f"WITH {cte('leases')} SELECT shard_id, owner FROM fx_leases WHERE expires_at > '{NOW}'")
def live_leases(spark, sf_dir):
    return leases.live_leases(timed(frame(spark, "leases"), "expires_at"), NOW_TIME).select("shard_id", "owner")


@query(f"WITH {cte('workers')} SELECT owner FROM fx_workers WHERE expires_at > '{NOW}'")
def live_workers(spark, sf_dir):
    w = timed(frame(spark, "workers"), "expires_at").withColumn("identity", F.lit("g:s"))
    return leases.live_workers(w, NOW_TIME).select("owner")


@query(f"""WITH {cte('beats')} SELECT last_success, now, epoch_ms(CAST(now AS TIMESTAMP)) >= epoch_ms(CAST(last_success AS TIMESTAMP)) + 15000 AS heartbeat_stale, epoch(CAST(now AS TIMESTAMP)) - epoch(CAST(last_success AS TIMESTAMP)) > 600 AS sync_stale FROM fx_beats""")
def staleness(spark, sf_dir):
    t = Tuning()
    last, now = F.col("last_success").cast("timestamp"), F.col("now").cast("timestamp")
    return frame(spark, "beats").select("last_success", "now", retry.heartbeat_stale(last, now, t.heartbeat_interval_ms, t.heartbeat_ttl_ms).alias("heartbeat_stale"), retry.sync_stale(last, now, t.max_staleness).alias("sync_stale"))


B64 = "rtrim(replace(replace(base64(encode({0})), '+', '-'), '/', '_'), '=')"
ESC = "replace(replace(replace(prefix, '%', '%25'), '{', '%7B'), '}', '%7D')"


@query(f"""WITH {cte('prefixes')} SELECT prefix, {ESC} || ':v2:' || {B64.format('identity')} || ':' || {B64.format('shard_id')} AS checkpoint_key,
  {ESC} || ':v2:{{' || CASE WHEN identity = '' THEN '-' ELSE {B64.format('identity')} END || '}}:lease-owners' AS owners_key,
  CASE WHEN prefix IN ('', 'kinesis-checkpoint') THEN 'kinesis-lease' ELSE prefix || '-lease' END AS lease_prefix FROM fx_prefixes""")
def stored_keys(spark, sf_dir):
    p, i, s = F.col("prefix"), F.col("identity"), F.col("shard_id")
    return frame(spark, "prefixes").select("prefix", keys.checkpoint_key(p, i, s).alias("checkpoint_key"), keys.lease_key(p, i, "lease_owners").alias("owners_key"), keys.lease_prefix(p).alias("lease_prefix"))


RENEWALS = [
    ("a", 0, "acquired"), ("a", 5000, "ok"), ("a", 10000, "error"), ("a", 15000, "error"), ("a", 20000, "ok"), ("a", 25000, "now"),
    ("b", 0, "acquired"), ("b", 5000, "error"), ("b", 10000, "error"), ("b", 15000, "error"), ("b", 20000, "error"), ("b", 25000, "ok"),
    ("c", 0, "acquired"), ("c", 5000, "ok"), ("c", 10000, "not_owned"), ("d", 0, "acquired"), ("d", 40000, "now"), ("e", 100, "acquired"), ("e", 30099, "ok"), ("e", 30500, "not_owned"), ("f", 0, "acquired"), ("f", 30000, "not_owned"),
]


@query("SELECT * FROM (VALUES ('b', 'expired', 20000::BIGINT), ('c', 'lost', 10000), ('d', 'fenced', 30000), ('e', 'lost', 30500), ('f', 'fenced', 30000)) AS v(shard_id, reason, at_ms)")
def renewal_stops(spark, sf_dir):
    return leasing.renew_stops(spark.createDataFrame(RENEWALS, "shard_id string, at_ms long, result string"), 20_000, 5_000)


def _ownership(spark):
    return frame(spark, "ready"), leases.live_leases(timed(frame(spark, "leases"), "expires_at"), NOW_TIME), leases.live_workers(timed(frame(spark, "workers"), "expires_at").withColumn("identity", F.lit("g:s")), NOW_TIME)


OWNED = f"""WITH {cte('ready', 'leases', 'workers', 'cooldown', 'local_workers')}, o AS (SELECT r.shard_id, nullif(l.owner, '') AS owner FROM fx_ready r LEFT JOIN (SELECT * FROM fx_leases WHERE expires_at > '{NOW}') l USING (shard_id)),
active AS (SELECT count(DISTINCT owner) AS w FROM (SELECT owner FROM fx_workers WHERE expires_at > '{NOW}' UNION ALL SELECT '{{me}}')),
s AS (SELECT w, count(*) AS open, count(*) FILTER (owner = '{{me}}') AS owned, count(*) FILTER (owner IS NULL) AS unowned FROM o, active GROUP BY w),
shares AS (SELECT w AS active_workers, open, CAST(floor(open / w) AS BIGINT) AS low, CAST(ceil(open / w) AS BIGINT) AS high, owned, unowned FROM s)"""


@query(OWNED.format(me="w9") + " SELECT * FROM shares")
def fair_shares(spark, sf_dir):
    return ownership.shares(*_ownership(spark), "w9")


@query(OWNED.format(me="w9") + " SELECT owner, count(*) AS shard_count, string_agg(shard_id, ',' ORDER BY shard_id) AS shard_ids FROM o WHERE owner IS NOT NULL GROUP BY owner")
def shards_by_owner(spark, sf_dir):
    ready, held, _ = _ownership(spark)
    return ownership.owners(ready, held)


@query(OWNED.format(me="w9") + " SELECT owner, count(*) AS shard_count FROM o WHERE owner IS NOT NULL AND owner <> 'w9' GROUP BY owner HAVING count(*) > 2 ORDER BY 2 DESC, 1 LIMIT 1")
def donor(spark, sf_dir):
    ready, held, _ = _ownership(spark)
    return ownership.pick_donor(ready, held, 2, "w9")


@query(OWNED.format(me="w9") + f""" SELECT shard_id FROM (SELECT shard_id, row_number() OVER (ORDER BY shard_id) AS k FROM o WHERE owner IS NULL AND shard_id NOT IN (SELECT shard_id FROM fx_cooldown WHERE until > '{NOW}')
  AND shard_id NOT IN (SELECT shard_id FROM fx_local_workers)) WHERE k <= (SELECT high - owned FROM shares)""")
def shards_to_acquire(spark, sf_dir):
    return ownership.sync_acquire(*_ownership(spark), "w9", timed(frame(spark, "cooldown"), "until"), frame(spark, "local_workers"), NOW_TIME)


@query("SELECT * FROM (VALUES ('a')) AS v(shard_id)")
def shards_to_shed(spark, sf_dir):
    ready, held, live = _ownership(spark)
    workers = live.unionByName(live.withColumn("owner", F.lit("w8")))
    return ownership.shed(ready.filter("shard_id in ('a', 'b', 'd', 'g')"), held, workers, "w1", timed(frame(spark, "cooldown"), "until"), frame(spark, "local_workers"), NOW_TIME, 2)


@query("SELECT * FROM (VALUES (0, 'acquire_unowned', 'shard-a', ''), (1, 'claim_donor', 'shard-b', 'donor')) AS v(action_no, kind, shard_id, donor)")
def plan_acquire_then_claim(spark, sf_dir):
    state = ownership.Snapshot(["shard-a", "shard-b", "shard-c", "shard-d"], {s: "donor" for s in ("shard-b", "shard-c", "shard-d")}, ["donor"], "me")
    return ownership.rebalance(spark, state, 3)


@query("SELECT * FROM (VALUES (0, 'claim_donor', 's0', 'donor-a')) AS v(action_no, kind, shard_id, donor)")
def plan_dead_zone_two_two_none(spark, sf_dir):
    state = ownership.Snapshot(["s0", "s1", "s2", "s3"], {"s0": "donor-a", "s1": "donor-a", "s2": "donor-b", "s3": "donor-b"}, ["donor-a", "donor-b"], "me")
    return ownership.rebalance(spark, state, 3)


@query("SELECT * FROM (VALUES (0, 'claim_donor', 's1', 'a')) AS v(action_no, kind, shard_id, donor)")
def plan_one_below_low(spark, sf_dir):
    held = {f"s{i}": "abc"[i // 3] for i in range(9)} | {"s9": "me"}
    return ownership.rebalance(spark, ownership.Snapshot(sorted(held), held, ["a", "b", "c"], "me", {"s0"}), 3)


@query("SELECT * FROM (VALUES (0, 'shed', 's1', ''), (1, 'shed', 's3', '')) AS v(action_no, kind, shard_id, donor)")
def plan_shed(spark, sf_dir):
    held = {f"s{i}": "me" for i in range(6)}
    state = ownership.Snapshot(sorted(held), held, ["me", "other", "third"], "me")
    return ownership.rebalance(spark, state, 2, cooling={"s0"}, running={"s0", "s1", "s3", "s4"})


def _pass(spark):
    """A pass planned from a snapshot in which b and c were the donor's and d and e free; since then other took c and e."""
    held = {"b": "donor", "c": "donor", "f": "donor", "g": "donor", "h": "other", "a": "me"}
    state = ownership.Snapshot(list("abcdefgh"), held, ["donor", "other", "me"], "me")
    later, past = "2024-05-01 12:00:30", "2024-05-01 11:59:00"
    now = [("a", "me", later), ("b", "donor", past), ("c", "donor", later), ("e", "donor", past), ("d", "other", later), ("f", "donor", later), ("g", "donor", later), ("h", "other", later)]
    leases_now = timed(spark.createDataFrame(now, "shard_id string, owner string, expires_at string"), "expires_at")
    return ownership.rebalance_pass(spark, state, leases_now, 4, NOW_TIME, 20_000, 10.0)


@query("SELECT * FROM (VALUES (0, 'acquire_unowned', 'd', '', 'skipped'), (1, 'acquire_unowned', 'e', '', 'moved')) AS v(action_no, kind, shard_id, donor, result)")
def plan_executed(spark, sf_dir):
    return _pass(spark)[0]


@query("""SELECT * FROM (VALUES ('a', 'me', '12:00:30'), ('b', 'donor', '11:59:00'), ('c', 'donor', '12:00:30'), ('d', 'other', '12:00:30'), ('e', 'me', '12:00:20'), ('f', 'donor', '12:00:30'), ('g', 'donor', '12:00:30'), ('h', 'other', '12:00:30')) AS v(shard_id, owner, expires)""")
def leases_after_pass(spark, sf_dir):
    return _pass(spark)[1].select("shard_id", "owner", F.date_format("expires_at", "HH:mm:ss").alias("expires"))


@query("SELECT * FROM (VALUES ('e', '12:00:10')) AS v(shard_id, until_)")
def cooldown_after_pass(spark, sf_dir):
    return _pass(spark)[2].select("shard_id", F.date_format("until", "HH:mm:ss").alias("until_"))


@query("""SELECT * FROM (VALUES (0, 'claim_donor', 's1', 'rich', 'moved'), (1, 'claim_donor', 's2', 'rich', 'skipped')) AS v(action_no, kind, shard_id, donor, result)""")
def plan_loses_a_race(spark, sf_dir):
    held = {f"s{i}": "rich" for i in range(1, 7)}
    state = ownership.Snapshot(sorted(held), held, ["rich", "third"], "me")
    now = [(s, "third" if s == "s2" else "rich", "2024-05-01 12:00:30") for s in sorted(held)]
    return ownership.rebalance_pass(spark, state, timed(spark.createDataFrame(now, "shard_id string, owner string, expires_at string"), "expires_at"), 3, NOW_TIME, 20_000, 10.0)[0]


@query("""SELECT * FROM (VALUES (0, 'shed', 's1', '', 'moved'), (1, 'shed', 's3', '', 'skipped')) AS v(action_no, kind, shard_id, donor, result)""")
def plan_sheds(spark, sf_dir):
    held = {f"s{i}": "me" for i in range(6)}
    state = ownership.Snapshot(sorted(held), held, ["me", "other", "third"], "me")
    now = [(s, "other" if s == "s3" else "me", "2024-05-01 12:00:30") for s in sorted(held)]
    return ownership.rebalance_pass(spark, state, timed(spark.createDataFrame(now, "shard_id string, owner string, expires_at string"), "expires_at"), 2, NOW_TIME, 20_000, 10.0, cooling={"s0"}, running={"s0", "s1", "s3", "s4"})[0]


@query("SELECT CAST(share AS DOUBLE) AS share, (10 + 4 * share)::DOUBLE AS seconds FROM (VALUES (0.0), (0.5), (1.0)) AS v(share)")
def rebalance_cadence(spark, sf_dir):
    return spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "share double").select("share", ownership.next_pass(10.0, 4.0, F.col("share")).alias("seconds"))


# ------------------------------------------------------------------ metrics


@query(f"""WITH RECURSIVE {outcome_sql(RECORD, 'dlq')}, {FOLD.format(every=300)}, c AS (
  SELECT shard_id, count(*) FILTER (outcome = 'processed') AS records_processed, count(*) FILTER (outcome = 'skipped') AS records_skipped, count(*) FILTER (outcome = 'dlq') AS dlq_records_published,
    CAST(sum(attempts - 1) AS BIGINT) AS handler_retries, count(DISTINCT page_no) AS pages_fetched, (SELECT count(*) FROM f WHERE due AND f.shard_id = o.shard_id) AS checkpoints_saved FROM o GROUP BY shard_id)
SELECT 'kinesis_consumer.' || name AS name, shard_id, CAST(value AS BIGINT) AS value FROM c UNPIVOT (value FOR name IN (records_processed, records_skipped, dlq_records_published, handler_retries, pages_fetched, checkpoints_saved))""")
def run_counters(spark, sf_dir):
    rows = outcome_rows(spark, sf_dir, RECORD_DLQ)
    return metrics.shard_counters(rows, checkpoints.saves_of(failures.progress(rows, RECORD_DLQ), 300, IDENTITY))


@query("SELECT * FROM (VALUES ('kinesis_consumer.owned_shards', 0.0::DOUBLE), ('kinesis_consumer.active_workers', 2.0), ('kinesis_consumer.fair_share_low', 0.0), ('kinesis_consumer.fair_share_high', 0.0)) AS v(name, value)")
def idle_gauges(spark, sf_dir):
    ready, held, live = _ownership(spark)
    return metrics.ownership_gauges(ownership.shares(ready.filter("false"), held, live, "w1"))


@query("""SELECT 'kinesis_consumer.' || name AS name, shard_id, value FROM (SELECT CASE
    WHEN op IN ('acquire', 'claim') AND ok THEN 'lease_acquired' WHEN op = 'renew' AND ok THEN 'lease_renewals' WHEN op = 'release' AND ok THEN 'lease_released' WHEN op IN ('renew', 'release') THEN 'lease_lost' END AS name, shard_id, count(*) AS value
  FROM (VALUES ('acquire', 'a', true), ('acquire', 'a', false), ('claim', 'a', false), ('claim', 'a', true), ('renew', 'a', false), ('renew', 'a', true), ('renew', 'a', false), ('acquire', 'a', true),
    ('acquire', 'b', true), ('release', 'b', false), ('release', 'b', true), ('acquire', 'b', true), ('acquire', 'b', false)) AS v(op, shard_id, ok) GROUP BY ALL) WHERE name IS NOT NULL""")
def lease_counters(spark, sf_dir):
    results = leases.fold(timed(frame(spark, "lease_ops"), "now"))
    return metrics.lease_counters(results.withColumn("error", F.lit(None).cast("string")))


@query("SELECT * FROM (VALUES ('kinesis_consumer.rebalance_moves', 'e', 'acquire', 1::BIGINT), ('kinesis_consumer.rebalance_skips', 'd', 'acquire', 1)) AS v(name, shard_id, kind, value)")
def rebalance_counters(spark, sf_dir):
    return metrics.rebalance_counters(_pass(spark)[0])


EVENTS = [
    ("read", "a", True, None, None), ("read", "a", True, None, None), ("read", "a", False, "throttle", None), ("read", "b", False, "expired", None), ("save", "a", True, None, None), ("save", "b", False, None, None),
    ("heartbeat", None, True, None, None), ("heartbeat", None, False, None, None), ("rebalance", None, False, None, None), ("rebalance", None, True, None, None), ("sync", None, False, None, None), ("shard_end", "b", True, None, None),
    ("worker_start", "a", True, None, None), ("worker_start", "b", True, None, None), ("worker_stop", "a", True, None, "error"), ("worker_stop", "b", True, None, "clean"), ("deregister", None, True, None, None), ("unknown", "a", True, None, None),
]
EVENT_COUNTS = [
    ("pages_fetched", "a", None, None, 2), ("get_records_failures", "a", "throttle", None, 1), ("get_records_failures", "b", "expired", None, 1), ("checkpoints_saved", "a", None, None, 1), ("checkpoint_failures", "b", None, None, 1),
    ("heartbeat_failures", None, None, None, 1), ("rebalance_pass_failures", None, None, None, 1), ("shard_sync_failures", None, None, None, 1), ("shards_completed", "b", None, None, 1), ("worker_starts", "a", None, None, 1),
    ("worker_starts", "b", None, None, 1), ("worker_stops", "a", None, "error", 1), ("worker_stops", "b", None, "clean", 1), ("worker_deregistered", None, None, None, 1),
]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query(f"SELECT 'kinesis_consumer.' || name AS name, shard_id, kind, outcome, CAST(value AS BIGINT) AS value FROM (VALUES {_values(EVENT_COUNTS)}) AS v(name, shard_id, kind, outcome, value)")
def event_counters(spark, sf_dir):
    return metrics.event_counters(spark.createDataFrame(EVENTS, "event string, shard_id string, ok boolean, kind string, outcome string"))


@query("""SELECT * FROM (VALUES ('kinesis_consumer.handler_duration', 'a', 1500.0::DOUBLE), ('kinesis_consumer.get_records_duration', 'a', 0.25), ('kinesis_consumer.checkpoint_save_duration', 'b', 3.0), ('kinesis_consumer.lease_acquire_duration', 'b', 10.0),
  ('kinesis_consumer.rebalance_pass_duration', NULL, 250.0), ('kinesis_consumer.drain_duration', NULL, 60000.0)) AS v(name, shard_id, value)""")
def operation_timings(spark, sf_dir):
    spans = [("handler", "a", "00", "01.5"), ("read", "a", "00", "00.00025"), ("save", "b", "10", "10.003"), ("acquire", "b", "10", "10.01"), ("rebalance", None, "20", "20.25"), ("drain", None, "-", "-"), ("other", "a", "00", "01")]
    rows = [(n, s, f"2024-05-01 12:00:{a}", f"2024-05-01 12:00:{b}") if n != "drain" else (n, s, "2024-05-01 12:00:00", "2024-05-01 12:01:00") for n, s, a, b in spans]
    return metrics.timings(timed(spark.createDataFrame(rows, "span string, shard_id string, began string, ended string"), "began", "ended")).select("name", "shard_id", "value")


@query(f"""WITH {outcome_sql(RECORD, 'skipped')}, c AS (SELECT 'records_processed' AS name, shard_id, count(*) FILTER (outcome = 'processed') AS v FROM o GROUP BY ALL UNION ALL SELECT 'records_skipped', shard_id, count(*) FILTER (outcome = 'skipped') FROM o GROUP BY ALL
  UNION ALL SELECT 'handler_retries', shard_id, sum(attempts - 1) FROM o GROUP BY ALL UNION ALL SELECT 'pages_fetched', shard_id, count(DISTINCT page_no) FROM o GROUP BY ALL)
SELECT 'kinesis_consumer.' || name || ':' || CAST(v AS BIGINT) || '|c|#stream:events,consumer_group:workers,policy:skip,shard:' || shard_id AS line FROM c WHERE v <> 0""")
def tagged_counters(spark, sf_dir):
    rows = outcome_rows(spark, sf_dir, RECORD_SKIP)
    counters = metrics.shard_counters(rows, spark.createDataFrame([], "shard_id string"))
    lines = metrics.tagged(counters, {"stream": STREAM, "consumer_group": GROUP, "policy": SKIP})
    return lines.select(metrics.statsd_line(F.col("name"), F.col("type"), F.col("value"), F.map_entries("tags")).alias("line"))


@query(f"""WITH {REC}, r AS (SELECT rec.*, (length(sequence_number), sequence_number) > CASE shard_id WHEN 'shardId-000000000000' THEN (3, '500') ELSE (0, '') END AS ahead FROM rec)
SELECT 'kinesis_consumer.millis_behind_latest' AS name, shard_id, CAST(max(epoch_us(ts) // 1000) - coalesce(max(epoch_us(ts) // 1000) FILTER (NOT ahead), min(epoch_us(ts) // 1000)) AS DOUBLE) AS value FROM r GROUP BY shard_id""")
def lag_gauges(spark, sf_dir):
    stored = spark.createDataFrame([("shardId-000000000000", "500")], "shard_id string, checkpoint string")
    return metrics.lag_gauges(positions.lag(source.from_events(spark, sf_dir), stored))


LINES = ["kinesis_consumer.records_processed:12|c|#stream:orders,shard:a", "kinesis_consumer.owned_shards:3.5|g|#stream:orders", "kinesis_consumer.drain_duration:1500|ms", "kinesis_consumer.drain_duration:0.25|ms|#stream:a_b_c,shard:s:1", "kinesis_consumer.records_processed:123456789|c|#stream:x"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in LINES) + ") AS v(line)")
def statsd_lines(spark, sf_dir):
    pairs = F.when(F.col("tags") == "", F.array().cast("array<struct<key:string,value:string>>")).otherwise(
        F.transform(F.split("tags", ","), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substring_index(t, "=", -1).alias("value")))
    )
    return frame(spark, "emitted").select(metrics.statsd_line(F.col("name"), F.col("type"), F.col("value"), pairs).alias("line"))


def emissions(spark, sf_dir) -> DataFrame:
    """The event table read as metric emissions: type as name, shard as tag."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.concat(F.lit(metrics.PREFIX), "event_type").alias("name"), source.shard_of(F.col("user_id")).alias("tag"), "value")


EMIT = "em AS (SELECT ts, event_id, 'kinesis_consumer.' || event_type AS name, 'shardId-' || lpad(CAST(user_id % 4 AS VARCHAR), 12, '0') AS tag, value FROM events)"


def _r(c: str):
    return F.round(c, 6).alias(c)


@query(f"""WITH {EMIT} SELECT epoch_ms(time_bucket(INTERVAL 10 SECOND, ts)) AS window_ms, name, tag, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS lower, round(max(value), 6) AS upper, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM em GROUP BY ALL""")
def interval_rollup(spark, sf_dir):
    r = metrics.rollup(emissions(spark, sf_dir))
    return r.select(F.unix_millis("window_start").alias("window_ms"), "name", "tag", "n", *[_r(c) for c in ("total", "lower", "upper", "mean", "stddev", "p50", "p90", "p95", "p99")])


@query(f"WITH {EMIT} SELECT name, tag, arg_max(value, event_id) AS last_value FROM em GROUP BY ALL")
def last_values(spark, sf_dir):
    return metrics.last_value(emissions(spark, sf_dir).withColumn("ts", F.col("event_id")), "name", "tag")


@query(f"""WITH {EMIT}, m AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS b, avg(value) AS v FROM em GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(b) FROM m), (SELECT max(b) FROM m), INTERVAL 1 MINUTE)) AS b)
SELECT epoch_ms(s.b) AS bucket_ms, round(m.v, 6) AS mean_value FROM s LEFT JOIN m ON s.b = m.b""")
def mean_by_minute(spark, sf_dir):
    m = metrics.mean_over_time(emissions(spark, sf_dir))
    return m.select(F.unix_millis("bucket").alias("bucket_ms"), _r("mean_value"))


@query(f"WITH {EMIT} SELECT DISTINCT name FROM em WHERE regexp_matches(name, '^kinesis_consumer\\.[a-e]')")
def matching_measurements(spark, sf_dir):
    return metrics.measurements(emissions(spark, sf_dir), "^kinesis_consumer\\.[a-e]")


@query(f"WITH {EMIT} SELECT DISTINCT tag AS tag_value FROM em")
def values_of_tag(spark, sf_dir):
    tagged = emissions(spark, sf_dir).withColumn("tags", F.create_map(F.lit("shard"), "tag"))
    return metrics.tag_values(tagged, "shard")


@query(f"""WITH {REC}, r AS (SELECT rec.*, (length(sequence_number), sequence_number) > CASE shard_id WHEN 'shardId-000000000000' THEN (3, '500') WHEN 'shardId-000000000001' THEN (3, '100') ELSE (0, '') END AS ahead FROM rec)
SELECT shard_id, count(*) FILTER (ahead) AS behind, max(epoch_us(ts) // 1000) - coalesce(max(epoch_us(ts) // 1000) FILTER (NOT ahead), min(epoch_us(ts) // 1000)) AS millis_behind_latest FROM r GROUP BY shard_id""")
def shard_lag(spark, sf_dir):
    stored = spark.createDataFrame([("shardId-000000000000", "500"), ("shardId-000000000001", f"{SHARD_END}:100")], "shard_id string, checkpoint string")
    return positions.lag(source.from_events(spark, sf_dir), stored)


# ------------------------------------------------------------------ streams: runs over a log in the shared folder


def _stream_run(spark, log: str, out: str, o: HandlerOptions, parts: tuple[str, ...] = (), **run) -> tuple[streaming.Run, object]:
    reader = spark.readStream.format("shardlog").option("path", log).option("marks", "true").option("progress", f"{out}/progress")
    for k, v in zip(parts[::2], parts[1::2]):
        reader = reader.option(k, v)
    r = streaming.Run(reader.load(), StreamConfig(GROUP, stream_name=STREAM), o, f"{out}/run", on_record=_no_error, sleep=_no_sleep, marks=True, **run)
    q = r.start(f"{out}/checkpoint")
    try:
        q.processAllAvailable()
        r.drain()
    finally:
        r.close()
    return r, q


def _no_error(row) -> None:
    if b"fail" in (row.data or b""):
        raise ValueError("poison")


def _log(spark, name: str) -> tuple[str, str]:
    source.register(spark)
    root = shared_folder(spark, name)
    return f"{root}/log", root


@query(f"WITH {REC} SELECT shard_id, count(*) AS n, 'workers:events' AS identity, arg_max(sequence_number, (length(sequence_number), sequence_number)) AS checkpoint FROM rec GROUP BY shard_id")
def stream_counts_restart(spark, sf_dir):
    """Half of the log in one run, the rest in a second one on the same checkpoint; nothing is read twice."""
    log, out = _log(spark, "stream-restart")
    records = source.from_events(spark, sf_dir)
    middle = records.count() // 2
    o = options(RECORD, SKIP, batch_size=1_000)
    source.export_log(records.filter(F.col("sequence_number").cast("long") <= middle), log)
    _stream_run(spark, log, out, o)
    source.export_log(records, log)
    r, _ = _stream_run(spark, log, out, o)
    counts = spark.read.parquet(f"{out}/run/outcomes").groupBy("shard_id").agg(F.count("*").alias("n"))
    return counts.join(r.stored(spark), "shard_id").select("shard_id", "n", "identity", "checkpoint")


@query(f"""WITH {REC} SELECT shard_id, count(*) AS n, CASE WHEN shard_id < 'shardId-000000000002' THEN 'SHARD_END:' ELSE '' END || arg_max(sequence_number, (length(sequence_number), sequence_number)) AS checkpoint,
  shard_id >= 'shardId-000000000002' AS waited FROM rec GROUP BY shard_id""")
def stream_parent_gating(spark, sf_dir):
    """Shards 0 and 1 are closed, 2 is a half of 0 and 3 the merger of 0 and 1: children are read in batches after their parents'."""
    log, out = _log(spark, "stream-gating")
    a, b, c, d = _first_shards(4)
    source.export_log(source.from_events(spark, sf_dir), log, closed=(a, b), parents={c: (a,), d: (a, b)})
    r, _ = _stream_run(spark, log, out, options(RECORD, SKIP, batch_size=1_000))
    rows = spark.read.parquet(f"{out}/run/outcomes").groupBy("shard_id").agg(F.count("*").alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    parents = rows.filter(F.col("shard_id") < c).agg(F.max("last").alias("ended")).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(parents, "_one").join(r.stored(spark), "shard_id").select("shard_id", "n", "checkpoint", (F.col("first") > F.col("ended")).alias("waited"))


@query(f"""WITH {REC}, m AS (SELECT CAST(ceil(count(*) / 20) AS BIGINT) AS m FROM rec), r AS (SELECT shard_id, sequence_number, row_number() OVER (PARTITION BY shard_id ORDER BY length(sequence_number), sequence_number) AS k, count(*) OVER (PARTITION BY shard_id) AS n, m FROM rec, m)
SELECT shard_id, sequence_number AS value FROM r WHERE k % (3 * m) = 0 OR k = n""")
def stream_cadence(spark, sf_dir):
    """Batches of a twentieth of the log a shard; the count goes on over batches, three to a save, and a tip is saved."""
    log, out = _log(spark, "stream-cadence")
    records = source.from_events(spark, sf_dir)
    most = -(-records.count() // 20)
    source.export_log(records, log)
    # not more than the third batch's last page reaches the count, whatever the size of pages
    _stream_run(spark, log, out, options(RECORD, SKIP, batch_size=1_000, checkpoint_every=3 * most), ("maxRecordsPerShardPerBatch", str(most)))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/run/saves").select("shard_id", "value")


def _publisher(row) -> None: ...


@query(f"""WITH {REC}, c AS (SELECT user_id % 4 AS s, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT 'shardId-' || lpad(CAST(s AS VARCHAR), 12, '0') AS shard_id, n AS published, CAST(n AS BIGINT) AS attempts FROM c""")
def stream_dead_letters(spark, sf_dir):
    log, out = _log(spark, "stream-dlq")
    r = source.from_events(spark, sf_dir)
    source.export_log(r.withColumn("data", F.when(F.col("poison"), F.lit("fail").cast("binary")).otherwise(F.lit("fine").cast("binary"))), log)
    _stream_run(spark, log, out, options(RECORD, SEND_TO_DLQ, batch_size=1_000), publisher=_publisher)
    poison, answered = spark.read.parquet(f"{out}/run/dlq"), spark.read.parquet(f"{out}/run/published")
    rows = answered.filter("publish_error is null").join(poison.select("idempotency_key", "shard_id"), "idempotency_key")
    return rows.groupBy("shard_id").agg(F.count("*").alias("published"), F.sum("publish_attempts").alias("attempts"))


# ------------------------------------------------------------------ extension


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS window_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def extension_windowed_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_counts(e).select(F.unix_millis("window_start").alias("window_ms"), "event_type", "n")
