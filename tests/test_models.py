"""Folds against small sequential models, on random logs; options; keys; source and runs."""

import hashlib
import json
import random
import socket
import struct
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline import model
from tideline.functions import keys
from tideline.operators import checkpoints, failures, handlers, leases, leasing, lineage, metrics, ownership, paging, stores
from tideline.plans import registry
from tideline.sources import records as source
from tideline.streaming.run import Run


def advance(stored, new):
    """The checkpoint left by one save."""
    if not new:
        return stored
    if not stored:
        return new
    if stored.startswith("SHARD_END"):
        return stored
    if new.startswith("SHARD_END"):
        return new
    return max(stored, new, key=lambda s: (len(s), s))


def test_merge_of_random_save_logs(spark):
    rnd, rows, expected = random.Random(1), [], {}
    for shard in range(120):
        stored = None
        for i in range(rnd.randint(1, 9)):
            v = rnd.choice([str(rnd.randint(0, 10 ** rnd.randint(1, 40))), "SHARD_END", f"SHARD_END:{rnd.randint(0, 9)}", "", None])
            rows.append(("i", f"s{shard}", i, v))
            stored = None if v is None else advance(stored, v)
        if stored:
            expected[f"s{shard}"] = stored
    got = checkpoints.merge_saves(spark.createDataFrame(rows, model.CHECKPOINT_SAVES))
    assert {r.shard_id: r.checkpoint for r in got.collect()} == expected


def test_cadence_of_random_pages(spark):
    rnd, rows, expected = random.Random(2), [], set()
    for shard in range(30):
        held = 0
        for page in range(rnd.randint(1, 12)):
            n, flush = rnd.randint(1, 20), rnd.random() < 0.1
            rows.append((f"s{shard}", page, n, str(page), flush))
            held += n
            if held >= 30 or flush:
                held = 0
                expected.add((f"s{shard}", page))
    df = spark.createDataFrame(rows, "shard_id string, page_no int, n long, last_seq string, flush boolean")
    got = checkpoints.due_pages(df, 30).filter("due").select("shard_id", "page_no")
    assert {tuple(r) for r in got.collect()} == expected


def test_crash_replays_from_the_last_due_page(spark):
    rows = [("s", str(i + 1), "k", bytearray(b"x"), None, None, 1) for i in range(120)]
    df = spark.createDataFrame(rows, "shard_id string, sequence_number string, partition_key string, data binary, approximate_arrival_timestamp timestamp, encryption_type string, succeeds_on int")
    o = model.HandlerOptions(tuning=model.Tuning(batch_size=10))
    done = failures.outcomes(paging.paginate(df, 10), o).filter("ordinal < 80")  # the page of ordinal 89 never ended
    saves = checkpoints.saves_of(failures.progress(done, o), 30, "g:s")
    assert checkpoints.merge_saves(saves).first().checkpoint == "60"  # ordinal 59


def test_lease_fold_of_random_logs(spark):
    rnd, t0, rows, expected = random.Random(3), datetime(2024, 1, 1), [], {}
    for shard in range(25):
        owner = until = None
        for i in range(12):
            now = t0 + timedelta(seconds=i * rnd.choice([1, 2]))
            op, who, ttl = rnd.choice(["acquire", "claim", "renew", "release"]), rnd.choice("ab"), rnd.choice([1000, 3000])
            live = owner is not None and until > now
            ok = {"acquire": not live, "claim": live and owner == "a", "renew": live and owner == who, "release": live and owner == who}[op]
            if ok:
                owner, until = (None, None) if op == "release" else (who, now + timedelta(milliseconds=ttl))
            index = shard * 100 + i
            rows.append((index, "g:s", now, op, f"s{shard}", who, "a", ttl))
            expected[index] = ok
    got = leases.fold(spark.createDataFrame(rows, model.LEASE_OPS))
    assert {r.op_index: r.ok for r in got.collect()} == expected


def test_plan_never_takes_a_donor_below_low():
    rnd = random.Random(4)
    for _ in range(300):
        ready = [f"s{i}" for i in range(rnd.randint(1, 12))]
        workers = ["me", *"abc"[: rnd.randint(0, 3)]]
        held = {s: rnd.choice([*workers, "", "gone"]) for s in ready}
        state = ownership.Snapshot(ready, held, workers, "me", set(rnd.sample(ready, rnd.randint(0, len(ready) // 2))))
        moves = ownership.plan(state, rnd.randint(0, 4))
        counts = {o: len(s) for o, s in state.by_owner.items()}
        for kind, shard, donor in moves:
            assert shard not in state.blocked and held[shard] == donor
            if kind == ownership.CLAIM:
                assert not [s for s in state.unowned if s not in state.blocked and s not in {m[1] for m in moves}]
                counts[donor] -= 1
                assert counts[donor] >= state.low
        assert len({m[1] for m in moves}) == len(moves)
        assert counts.get("me", 0) + len(moves) <= max(state.high, counts.get("me", 0))


def test_uneven_share():
    state = ownership.Snapshot(["a", "b", "c", "d", "e"], {}, ["w1", "w2"], "w1")
    assert (state.low, state.high) == (2, 3)


def test_idempotency_key_is_framed_by_bytes(spark):
    fields = ["gruppe", "ström", "", "17", "record"]
    digest = hashlib.sha256(b"".join(struct.pack(">Q", len(f.encode())) + f.encode() for f in fields)).hexdigest()
    got = spark.range(1).select(keys.idempotency_key(*map(F.lit, fields)).alias("k")).first().k
    assert got == "kcg-dlq-v1:" + digest


@pytest.mark.parametrize(
    "bad",
    [
        {"consumer_group": "g"}, {"consumer_group": "g", "stream_name": "s", "stream_arn": "arn:aws:kinesis:r:123456789012:stream/s"}, {"consumer_group": "", "stream_name": "s"},
        {"consumer_group": "a b", "stream_name": "s"}, {"consumer_group": "g", "stream_name": "x" * 129}, {"consumer_group": "g", "stream_name": "s", "start_position": "EARLIEST"},
        {"consumer_group": "g", "stream_name": "s", "start_position": "AT_TIMESTAMP"}, {"consumer_group": "g", "stream_arn": "arn:aws:kinesis:r:1:stream/s"},
    ],
)
def test_bad_configs(bad):
    with pytest.raises(ValueError):
        model.StreamConfig(**bad)


def test_identity():
    assert model.StreamConfig("g", stream_arn="arn:aws:kinesis:r:123456789012:stream/s").identity == "g:s"


@pytest.mark.parametrize("bad", [{"batch_size": 0}, {"batch_size": 10_001}, {"heartbeat_ttl_ms": 14_999}, {"retry_max_attempts": 0}, {"checkpoint_every": 0}, {"max_moves": 0}, {"shard_sync_interval": 0.5}, {"shard_sync_max_staleness": 1.0}, {"poll_interval": 0}])
def test_bad_tuning(bad):
    with pytest.raises(ValueError):
        model.Tuning(**bad)


def test_retry_sleeps_linearly_and_turns_panics_into_errors():
    slept = []

    def panics():
        raise SystemExit("gone")

    attempts, error = handlers.call_with_retry(panics, 3, 1.0, slept.append)
    assert attempts == 3 and slept == [1.0, 2.0] and isinstance(error, model.HandlerPanic)
    with pytest.raises(ValueError):
        model.one_handler(None, None)


def test_fail_fast_raises(spark):
    df = spark.createDataFrame([("s", 0, 0, True)], "shard_id string, ordinal int, page_no int, poison boolean")

    def fails(row):
        raise ValueError("no")

    with pytest.raises(Exception, match="failed after 3 attempts"):
        handlers.run_handler(df, model.HandlerOptions(), on_record=fails, sleep=lambda s: None).collect()


def test_publish_retries_and_times_out(spark):
    df = spark.createDataFrame([("k1",), ("k2",)], "idempotency_key string").coalesce(1)

    def publisher(row):
        if row["idempotency_key"] == "k2":
            raise OSError("down")

    rows = {r[0]: (r[1], r[2]) for r in handlers.publish(df, publisher, sleep=lambda s: None).collect()}
    assert rows == {"k1": (1, None), "k2": (3, "down")}


def test_acquire_all_gives_back():
    class Store:
        held: list = []

        def acquire(self, s):
            if s == "c":
                raise OSError
            self.held.append(s)
            return True

        def release(self, s):
            self.held.remove(s)

    store = Store()
    with pytest.raises(OSError):
        leases.acquire_all(store, ["a", "b", "c"], sleep=lambda s: None)
    assert store.held == []
    slots = leases.Slots(1)
    assert slots.reserve("a") and not slots.reserve("a") and not slots.reserve("b")


def test_children_wait_for_parents(spark):
    shards = spark.createDataFrame([("p", None, None), ("c1", "p", None), ("c2", "p", None)], model.SHARDS)
    none = spark.createDataFrame([], "shard_id string, checkpoint string")
    assert [r[0] for r in lineage.ready(shards, none).collect()] == ["p"]
    ended = spark.createDataFrame([("p", "SHARD_END:12")], "shard_id string, checkpoint string")
    assert sorted(r[0] for r in lineage.ready(shards, ended).collect()) == ["c1", "c2"]


def log(tmp_path, n=30):
    path = str(tmp_path / "log")
    source.write_shard_log([(f"s{i % 2}", str(i + 1), f"pk-{i}", f"tag-{i}".encode()) for i in range(n)], path)
    return path


def test_batch_source_prunes_shards(spark, tmp_path):
    source.register(spark)
    path = log(tmp_path)
    df = spark.read.format("shardlog").option("path", path).load()
    assert df.count() == 30
    assert df.filter("shard_id = 's1'").count() == 15
    part = spark.read.format("shardlog").option("path", path).option("after", json.dumps({"s0": "9", "s1": "30"})).load()
    assert sorted(int(r.sequence_number) for r in part.collect()) == list(range(11, 30, 2))


def test_stream_restarts_after_its_offsets(spark, tmp_path):
    source.register(spark)
    path, out = log(tmp_path), str(tmp_path / "out")
    config = model.StreamConfig("g", stream_name="s")
    options = model.HandlerOptions(policy="skip", tuning=model.Tuning(batch_size=10))

    def once():
        stream = spark.readStream.format("shardlog").option("path", path).load()
        run = Run(stream, config, options, out, on_record=lambda row: None, sleep=lambda s: None)
        q = run.start(str(tmp_path / "cp"))
        q.processAllAvailable()
        with pytest.raises(model.AlreadyStarted):
            run.start(str(tmp_path / "cp"))
        rows = run.health()["rows"]
        run.close()
        return run, rows

    run, rows = once()
    assert rows == 30
    source.write_shard_log([("s0", "31", "k", b"x"), ("s2", "5", "k", b"x")], path)
    run, rows = once()
    assert rows == 2
    assert {r.shard_id: r.checkpoint for r in run.stored(spark).collect()} == {"s0": "31", "s1": "30", "s2": "5"}
    assert spark.read.parquet(out + "/outcomes").count() == 32


def test_health_counts_beyond_recent_progress(spark, tmp_path):
    source.register(spark)
    path = log(tmp_path)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        stream = spark.readStream.format("shardlog").option("path", path).load()
        run = Run(stream, model.StreamConfig("g", stream_name="s"), model.HandlerOptions(policy="skip", tuning=model.Tuning(batch_size=10)), str(tmp_path / "out"), on_record=lambda row: None, sleep=lambda s: None)
        q = run.start(str(tmp_path / "cp"))
        q.processAllAvailable()
        source.write_shard_log([("s0", "31", "k", b"x")], path)
        q.processAllAvailable()
        health = run.health()
        run.close()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert (health["batches"], health["rows"]) == (2, 31)


def log_lines(path, shard):
    return [json.loads(x) for x in open(f"{path}/{shard}.jsonl")]


def records_of(shard, first, last, data=b"x"):
    return [(shard, str(i), "k", data) for i in range(first, last + 1)]


class Stream:
    """Runs over one log, each on the same checkpoint."""

    def __init__(self, spark, tmp_path, options, **reading):
        source.register(spark)
        self.spark, self.dir, self.options, self.reading = spark, tmp_path, options, reading
        self.log, self.out = str(tmp_path / "log"), str(tmp_path / "out")

    def run(self, drain=True, **run):
        reader = self.spark.readStream.format("shardlog").options(path=self.log, marks="true", progress=str(self.dir / "progress"), **self.reading)
        r = Run(reader.load(), model.StreamConfig("g", stream_name="s"), self.options, self.out, on_record=run.pop("on_record", lambda row: None), sleep=lambda s: None, marks=True, **run)
        q = r.start(str(self.dir / "cp"))
        try:
            q.processAllAvailable()
            if drain:
                r.drain()
        finally:
            r.close()
        return r

    def stored(self, r):
        return {x.shard_id: x.checkpoint for x in r.stored(self.spark).collect()}

    def saves(self):
        return sorted((x.epoch, x.shard_id, x.value) for x in self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.out}/saves").collect())

    def outcomes(self):
        rows = self.spark.read.parquet(f"{self.out}/outcomes").collect()
        return [(x.epoch, x.shard_id, int(x.sequence_number), x.outcome) for x in rows]


def test_children_are_read_after_their_parents_end(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip"), maxRecordsPerShardPerBatch="2")
    source.write_shard_log(records_of("p", 1, 3) + records_of("q", 1, 5) + records_of("child", 10, 12) + records_of("merged", 20, 21) + records_of("far", 1, 1), s.log, closed=("p",), parents={"child": ("p",), "merged": ("p", "q"), "far": ("unlisted",)})
    r = s.run()
    seen = {}
    for epoch, shard, *_ in s.outcomes():
        seen.setdefault(shard, []).append(epoch)
    assert max(seen["p"]) < min(seen["child"]) and "merged" not in seen and min(seen["far"]) == 0
    assert s.stored(r) == {"p": "SHARD_END:3", "q": "5", "child": "12", "far": "1"}
    source.write_shard_log([], s.log, closed=("q",))
    r = s.run()  # the other parent has ended with no further record
    assert s.stored(r) == {"p": "SHARD_END:3", "q": "SHARD_END:5", "child": "12", "far": "1", "merged": "21"}
    assert sorted(x[2] for x in s.outcomes() if x[1] == "q") == [1, 2, 3, 4, 5]


def test_limits_hold_over_restarts(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip"), maxRecordsPerShardPerBatch="4")
    source.write_shard_log(records_of("a", 1, 10), s.log)
    s.run()
    source.write_shard_log(records_of("a", 11, 13), s.log)
    s.run()
    assert sorted(x[2] for x in s.outcomes()) == list(range(1, 14))
    assert max(sum(1 for x in s.outcomes() if x[0] == e) for e in {x[0] for x in s.outcomes()}) <= 4


def test_positions_of_streams(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip"), start="LATEST")
    source.write_shard_log(records_of("a", 1, 3), s.log)
    s.run()
    source.write_shard_log(records_of("a", 4, 5), s.log)
    s.run()
    assert sorted(x[2] for x in s.outcomes()) == [4, 5]
    at = Stream(spark, tmp_path / "at", model.HandlerOptions(policy="skip"), start="AT_TIMESTAMP", startTimestamp="2024-05-01T12:00:00")
    rows = [("a", "1", "k", b"x", "2024-05-01T11:59:59"), ("a", "2", "k", b"x", "2024-05-01T12:00:00"), ("a", "3", "k", b"x", "2024-05-01T12:00:09+00:00"), ("kid", "7", "k", b"x", "2024-05-01T11:00:00")]
    source.write_shard_log(rows, at.log, closed=("a",), parents={"kid": ("a",)})
    at.run()
    assert sorted(x[2] for x in at.outcomes()) == [2, 3, 7]  # a child starts at its beginning
    resumed = Stream(spark, tmp_path / "resumed", model.HandlerOptions(policy="skip"), after=json.dumps({"a": "2", "b": "SHARD_END:9"}))
    source.write_shard_log(records_of("a", 1, 4) + records_of("b", 1, 9), resumed.log)
    resumed.run()
    assert sorted(x[1:3] for x in resumed.outcomes()) == [("a", 3), ("a", 4)]


def test_cadence_goes_on_over_batches(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip", tuning=model.Tuning(batch_size=2, checkpoint_every=5)), maxRecordsPerShardPerBatch="2")
    source.write_shard_log(records_of("a", 1, 9), s.log)
    r = s.run(drain=False)
    assert [x[1:] for x in s.saves()] == [("a", "6"), ("a", "9")]  # three pages of two; then the tip
    assert s.stored(r) == {"a": "9"}


def test_drain_saves_what_is_pending_and_no_end(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip", tuning=model.Tuning(batch_size=2, checkpoint_every=100)))
    source.write_shard_log(records_of("a", 1, 3), s.log, closed=("a",))
    reader = spark.readStream.format("shardlog").options(path=s.log, marks="true", progress=str(tmp_path / "progress"))
    r = Run(reader.load(), model.StreamConfig("g", stream_name="s"), s.options, s.out, on_record=lambda row: None, sleep=lambda s: None, marks=True)
    r.draining = True  # as if the drain began while the batch ran
    r.start(str(tmp_path / "cp")).processAllAvailable()
    r.drain()
    assert s.stored(r) == {"a": "3"}
    source.write_shard_log(records_of("b", 1, 1), s.log)
    assert s.stored(s.run()) == {"a": "SHARD_END:3", "b": "1"}


def test_fail_fast_covers_the_pages_before(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(tuning=model.Tuning(batch_size=2, checkpoint_every=2)))
    source.write_shard_log(records_of("a", 1, 4) + records_of("a", 5, 5, b"bad") + records_of("a", 6, 8) + records_of("b", 1, 2), s.log)

    def picky(row):
        if row.data == b"bad":
            raise ValueError("no")

    with pytest.raises(Exception, match="shard a, record 5: failed after 3 attempts: no"):
        s.run(on_record=picky)
    assert [x[1:] for x in s.saves()] == [("a", "2"), ("a", "4"), ("b", "2")]
    assert {(x[2], x[3]) for x in s.outcomes() if x[1] == "a" and x[2] > 4} == {(5, "failed"), (6, "unread"), (7, "unread"), (8, "unread")}
    assert s.stored(s.run()) == {"a": "8", "b": "2"}  # the batch comes again


def test_lost_dead_letter_holds_its_page(spark, tmp_path):
    options = model.HandlerOptions(policy="send-to-dlq", has_publisher=True, tuning=model.Tuning(batch_size=2, checkpoint_every=100, publish_max_attempts=2))
    s = Stream(spark, tmp_path, options)
    source.write_shard_log(records_of("a", 1, 2, b"bad") + records_of("a", 3, 3) + records_of("a", 4, 4, b"bad") + records_of("a", 5, 6), s.log)

    def picky(row):
        if row.data == b"bad":
            raise ValueError("no")

    def publisher(row):
        if row["sequence_number"] == "4":
            raise OSError("down")

    with pytest.raises(Exception, match="record 4: failed after 3 attempts: no; its dead letter was not published: down"):
        s.run(on_record=picky, publisher=publisher)
    assert [x[1:] for x in s.saves()] == [("a", "2")]  # published letters save their page at once; the page of 4 and those after stay
    answered = {x.publish_attempts: x.publish_error for x in spark.read.parquet(f"{s.out}/published").collect()}
    assert answered == {1: None, 2: "down"}
    r = s.run(on_record=picky, publisher=lambda row: None)
    assert s.stored(r) == {"a": "6"}
    keys = [x.idempotency_key for x in spark.read.parquet(f"{s.out}/dlq").collect()]
    assert len(keys) == len(set(keys)) == 3


def test_a_hanging_attempt_holds_up_no_other(spark):
    df = spark.createDataFrame([("k1",), ("k2",)], "idempotency_key string").coalesce(1)

    def publisher(row):
        if row["idempotency_key"] == "k1":
            time.sleep(60)

    began = time.monotonic()
    rows = {r[0]: (r[1], r[2]) for r in handlers.publish(df, publisher, deadline=0.3, sleep=lambda s: None).collect()}
    assert rows["k1"][0] == 3 and "0.3 s" in rows["k1"][1] and rows["k2"] == (1, None) and time.monotonic() - began < 30


def test_first_error_stops_the_hand_out():
    seen, gate = [], threading.Event()

    def one(i):
        seen.append(i)
        if i == 1:
            raise ValueError("no")
        if i == 0:
            gate.wait(5)
        return i

    threading.Timer(0.2, gate.set).start()
    results, error = handlers.hand_out(list(range(100)), 2, one)
    assert str(error) == "no" and sorted(seen) == [0, 1] and results[0] == 0 and results[1:] == [None] * 99
    assert handlers.hand_out(list(range(7)), 3, lambda i: i * i) == ([i * i for i in range(7)], None)
    assert handlers.hand_out([], 3, one) == ([], None)


def test_batch_handlers_see_whole_pages_in_order(spark):
    df = spark.range(25).selectExpr("'s' || (id % 2) shard_id", "cast(id as string) sequence_number", "cast(id div 2 as int) ordinal", "cast(id div 8 as int) page_no")
    sizes = handlers.run_handler(df, model.HandlerOptions(kind="batch", policy="skip"), on_batch=lambda rows: None if [r.ordinal for r in rows] == sorted(r.ordinal for r in rows) and len({r.page_no for r in rows}) == 1 else 1 / 0, sleep=lambda s: None)
    assert {r.outcome for r in sizes.collect()} == {"processed"}
    bad = handlers.run_handler(df, model.HandlerOptions(kind="batch"), on_batch=lambda rows: 1 / 0 if rows[0].page_no == 1 and rows[0].shard_id == "s1" else None, sleep=lambda s: None, raises=False)
    got = {(r.shard_id, r.page_no): r.outcome for r in bad.collect()}
    assert got["s1", 0] == "processed" and got["s1", 1] == "failed" and got["s1", 2] == "unread" and {got["s0", i] for i in range(4)} == {"processed"}


def test_stale_heartbeat_stops_the_run(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip", tuning=model.Tuning(heartbeat_interval_ms=50, heartbeat_ttl_ms=400)))
    source.write_shard_log(records_of("a", 1, 1), s.log)

    def beat():
        raise OSError("store is down")

    reader = spark.readStream.format("shardlog").options(path=s.log, marks="true")
    r = Run(reader.load(), model.StreamConfig("g", stream_name="s"), s.options, s.out, on_record=lambda row: None, sleep=lambda s: None, marks=True, heartbeat=beat, sync=lambda: None)
    r.start(str(tmp_path / "cp"))
    with pytest.raises(model.HeartbeatStale):
        r.wait(60)
    health = r.health()
    assert "store is down" in health["error"] and health["heartbeat_failures"] > 1 and health["sync_failures"] == 0


def test_acquire_is_tried_again():
    class Store:
        def __init__(self):
            self.calls, self.held = 0, []

        def acquire(self, s):
            self.calls += 1
            if self.calls in (1, 3):
                raise OSError
            self.held.append(s)
            return True

    store, slept = Store(), []
    assert leases.acquire_all(store, ["a", "b"], sleep=slept.append) == ["a", "b"] and slept == [1.0, 1.0]


def test_reporter_gets_tagged_counters(spark, tmp_path):
    s, got = Stream(spark, tmp_path, model.HandlerOptions(policy="skip", tuning=model.Tuning(batch_size=2))), []
    source.write_shard_log(records_of("a", 1, 5), s.log)
    s.run(reporter=lambda row: got.append((row.name, row.value, dict(row.tags))))
    tags = {"stream": "s", "consumer_group": "g", "handler": "record", "policy": "skip", "shard": "a"}
    assert ("kinesis_consumer.records_processed", 5.0, tags) in got and ("kinesis_consumer.pages_fetched", 3.0, tags) in got and ("kinesis_consumer.checkpoints_saved", 1.0, tags) in got


def test_late_epochs_sort_after_early_ones(spark, tmp_path):
    s = Stream(spark, tmp_path, model.HandlerOptions(policy="skip"))
    for epoch, value in ((5, "7"), (300_000, "9")):
        spark.createDataFrame([("g:s", "a", 0, value, epoch)], "identity string, shard_id string, arrival_index int, value string, epoch int").write.parquet(f"{s.out}/saves/epoch={epoch}")
    r = Run(spark.range(0), model.StreamConfig("g", stream_name="s"), s.options, s.out, on_record=print)
    assert s.stored(r) == {"a": "9"}


def test_every_metric_of_the_catalog_is_emitted(spark):
    from tideline.plans import registry

    names = set()
    for query in ("run_counters", "lease_counters", "rebalance_counters", "event_counters", "operation_timings", "lag_gauges", "idle_gauges"):
        names |= {r.name for r in registry.QUERIES[query](spark, "/root/testdata/sf0.001").select("name").distinct().collect()}
    failed = spark.createDataFrame([("renew", "a", False, "down"), ("release", "a", False, "down")], "op string, shard_id string, ok boolean, error string")
    names |= {r.name for r in metrics.lease_counters(failed).collect()}
    assert names == {metrics.PREFIX + n for n in (*metrics.COUNTERS, *metrics.GAUGES, *metrics.TIMINGS)}


FAST = model.Tuning(heartbeat_interval_ms=30, heartbeat_ttl_ms=120, lease_release_timeout=0.2)


class Flaky(leasing.MemoryLeases):
    """Fails or hangs in renewals and releases as told."""

    mode = ""

    def renew(self, shard, owner, ttl):
        if self.mode == "down":
            raise OSError("down")
        if self.mode == "hangs":
            threading.Event().wait(5)
        super().renew(shard, owner, ttl)

    def release(self, shard, owner):
        if self.mode == "hangs":
            threading.Event().wait(5)
        super().release(shard, owner)


def held_store(mode=""):
    store = Flaky()
    assert store.acquire("a", "me", 0.12) and not store.acquire("a", "you", 1)
    store.mode = mode
    return store


def test_lease_is_renewed_while_work_runs():
    store = held_store()
    assert leasing.run_held(store, "a", "me", lambda lost: lost.wait(0.5) and 1 / 0, FAST) == "released"
    assert store.owners() == {}


def test_lost_lease_is_a_handoff():
    store = held_store()

    def work(lost):
        store.leases["a"] = ("you", store.now() + timedelta(seconds=9))
        assert lost.wait(5)

    assert leasing.run_held(store, "a", "me", work, FAST) == "lost" and store.owners() == {"a": "you"}
    with pytest.raises(ZeroDivisionError):
        leasing.run_held(store, "a", "me", lambda lost: lost.wait(5) and 1 / 0, FAST)


@pytest.mark.parametrize("mode", ["down", "hangs"])
def test_lease_without_renewals_expires(mode):
    store, began = held_store(mode), time.monotonic()
    with pytest.raises(leasing.LeaseExpired):
        leasing.run_held(store, "a", "me", lambda lost: lost.wait(5) or 1 / 0, FAST)
    assert time.monotonic() - began < 2


def test_short_outages_are_lived_through():
    store = held_store("down")
    store.leases["a"] = ("me", store.now() + timedelta(seconds=9))
    threading.Timer(0.06, lambda: setattr(store, "mode", "")).start()
    with leasing.Held(store, "a", "me", FAST) as held:
        assert not held.lost.wait(0.4) and held.renewals > 1 and held.failures > 0
    assert held.release() == "released" and held.release() == "lost"


def test_release_is_bounded():
    held = leasing.Held(held_store("hangs"), "a", "me", FAST)
    began = time.monotonic()
    assert held.release() == "failed" and time.monotonic() - began < 2


def test_workers_of_the_memory_store():
    at = [datetime(2024, 5, 1)]
    store = leasing.MemoryLeases(lambda: at[0])
    store.heartbeat("b", 10), store.heartbeat("a", 20), store.acquire("s", "a", 10), store.claim("s", "a", "b", 10)
    assert store.workers() == ["a", "b"] and store.owners() == {"s": "b"}
    at[0] += timedelta(seconds=10)
    assert store.workers() == ["a"] and store.owners() == {} and store.acquire("s", "c", 5)
    store.deregister("a"), store.deregister("nobody")
    assert store.workers() == []
    with pytest.raises(model.NotOwned):
        store.renew("s", "a", 5)


def test_stores_agree_with_the_merge(spark, tmp_path):
    r, memory, table = random.Random(4), stores.MemoryCheckpoints(), stores.TableCheckpoints(spark, str(tmp_path / "store"))
    model_values = {}
    for _ in range(14):
        shard, value = r.choice("ab"), r.choice(["5", "10", "9", "100", "SHARD_END:10", "SHARD_END", "", None])
        for store in (memory, table):
            if value is None:
                store.delete("g:s", shard)
            else:
                moved = store.save("g:s", shard, value)
                assert moved == (advance(model_values.get(shard), value) != model_values.get(shard))
        model_values[shard] = None if value is None else advance(model_values.get(shard), value)
        assert memory.get("g:s", shard) == (model_values[shard] or "")
    for shard in "ab":
        assert table.get("g:s", shard) == memory.get("g:s", shard)
    table.write(spark.createDataFrame([("g:s", "c", "7"), ("h:s", "c", "8")], "identity string, shard_id string, value string"))
    assert table.get("g:s", "c") == "7" and table.get("h:s", "c") == "8"
    memory.values["g:s", "x"] = "07"
    with pytest.raises(model.InvalidStoredCheckpoint):
        memory.save("g:s", "x", "9")


def test_store_calls_are_tried_again_at_a_constant_pace():
    class Down(stores.MemoryCheckpoints):
        left = 2

        def save(self, *args):
            self.left -= 1
            if self.left >= 0:
                raise OSError("down")
            return super().save(*args)

    slept, store = [], Down()
    retrying = stores.Retrying(store, sleep=slept.append)
    assert retrying.save("g:s", "a", "1") and slept == [1.0, 1.0] and retrying.get("g:s", "a") == "1"
    store.left = 3
    with pytest.raises(OSError):
        retrying.save("g:s", "a", "2")
    store.values["g:s", "x"], store.left = "x", 0
    with pytest.raises(model.InvalidStoredCheckpoint):
        retrying.save("g:s", "x", "2")
    assert slept == [1.0] * 4
    retrying.delete("g:s", "x"), retrying.delete("g:s", "x")


def test_statsd_reporter_sends_lines():
    class Row:
        def __init__(self, name, type_, value, tags):
            self.name, self.type, self.value, self.tags = name, type_, value, tags

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as there:
        there.bind(("127.0.0.1", 0))
        there.settimeout(5)
        send = metrics.StatsdReporter(port=there.getsockname()[1])
        send(Row("a.b", "c", 12.0, {"shard": "s|1"}))
        assert there.recv(999) == b"a.b:12|c|#shard:s_1"
        send(Row("a.b", "ms", 0.25, None))
        assert there.recv(999) == b"a.b:0.25|ms"
    assert send.line(Row("x", "g", 1e21, {})) == "x:1000000000000000000000|g" and send.line(Row("x", "g", 1.5e-7, {})) == "x:0.00000015|g"


def events(spark, path, rows):
    """An event table of ``rows`` (event_id, user_id) below ``path``."""
    e = rows.select("event_id", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_open_shards_with_saves_are_not_shown_as_closed(spark, tmp_path):
    ids = spark.range(1_000_100).withColumnRenamed("id", "event_id")
    sf = events(spark, tmp_path, ids.withColumn("user_id", F.when(F.col("event_id") < 10, F.col("event_id") % 4).otherwise(2)))
    got = registry.checkpoint_of_closed_shards(spark, sf)
    assert sorted(map(tuple, got.collect())) == [("workers:events", "shardId-000000000000", "SHARD_END:9"), ("workers:events", "shardId-000000000001", "SHARD_END:10")]


def test_cadence_query_saves_every_third_batch_of_several_pages(spark, tmp_path):
    ids = spark.range(204_000).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("user_id"))
    got = registry.stream_cadence(spark, events(spark, tmp_path, ids))
    expected = sorted((f"shardId-{s:012d}", str(s + 1 + 4 * (k - 1))) for s in range(4) for k in (30_600, 51_000))
    assert sorted(map(tuple, got.collect())) == expected


def test_cadence_query_runs_alike_at_each_size(spark, tmp_path, monkeypatch):
    taken = []

    class Taken(Exception): ...

    def stop(spark, log, out, o, parts):
        taken.append((o.tuning.batch_size, o.tuning.checkpoint_every / int(parts[1])))
        raise Taken

    monkeypatch.setattr(registry, "_stream_run", stop)
    for n in (200, 20_000, 220_000):
        ids = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("user_id"))
        with pytest.raises(Taken):
            registry.stream_cadence(spark, events(spark, tmp_path / str(n), ids))
    assert len(set(taken)) == 1


def test_small_pages_are_handled_from_few_frames(monkeypatch):
    import pandas as pd

    frames = [pd.DataFrame({"shard_id": ["a"] * 4_000 + ["b"] * 4_000, "ordinal": [*range(4_000)] * 2, "page_no": [i // 10 for i in range(4_000)] * 2}).iloc[a:b] for a, b in ((0, 3_995), (3_995, 4_003), (4_003, 4_003), (4_003, 8_000))]
    made = list(handlers.whole_pages(iter(frames)))
    assert len(made) <= len(frames) + 1
    pages = [pdf.iloc[a:b] for pdf, cuts in made for a, b in zip(cuts, cuts[1:])]
    assert [(p.shard_id.iloc[0], p.page_no.iloc[0], len(p)) for p in pages] == [(s, i, 10) for s in "ab" for i in range(400)]
    assert all(p.shard_id.nunique() == p.page_no.nunique() == 1 for p in pages)


def test_no_task_keeps_two_sorts_of_dead_pages(spark, tmp_path):
    ids = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("user_id"))
    df = registry.poison_pages(spark, events(spark, tmp_path, ids))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Sort [") <= plan.count("Exchange hashpartitioning(")
    assert plan.count("max(") == 1
