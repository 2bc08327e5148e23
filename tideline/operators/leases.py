"""Leases and worker liveness as folds over a log of operations.

Inside one streaming query Spark itself assigns shards to tasks; the fold keeps the rules
of shared leases testable and answers who owned what, from a log.
"""

from __future__ import annotations

import time
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = "op_index int, identity string, op string, shard_id string, owner string, ok boolean"


def _live(entry: tuple | None, now) -> bool:
    return entry is not None and entry[1] > now


def step(entry: tuple | None, op: str, owner: str, expected: str | None, now, ttl) -> tuple[tuple | None, bool]:
    """The lease (owner, expiry) after one operation, and whether it took effect."""
    live = _live(entry, now)
    if op == "acquire":
        ok = not live
    elif op == "claim":
        ok = live and entry[0] == expected
    elif op in ("renew", "release"):
        ok = live and entry[0] == owner
    else:
        raise ValueError(f"lease operation {op!r}")
    if not ok:
        return entry, False
    return (None if op == "release" else (owner, now + ttl)), True


def fold(ops: DataFrame, only_final: bool = False) -> DataFrame:
    """Each shard's operations in order: whether each took effect; or, ``only_final``, the leases left.

    A shard's log is one group; logs of different shards are folded apart.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, rows = None, []
        for r in pdf.sort_values("op_index").itertuples():
            entry, ok = step(entry, r.op, r.owner, r.expected_owner, r.now, pd.Timedelta(milliseconds=int(r.ttl_ms or 0)) if pd.notna(r.ttl_ms) else pd.Timedelta(0))
            rows.append((r.op_index, r.identity, r.op, r.shard_id, r.owner, ok))
        if only_final:
            first = pdf.iloc[0]
            return pd.DataFrame([(first.identity, first.shard_id, *entry)] if entry else [], columns=["identity", "shard_id", "owner", "expires_at"])
        return pd.DataFrame(rows, columns=["op_index", "identity", "op", "shard_id", "owner", "ok"])

    shard_ops = ops.filter(F.col("op").isin("acquire", "claim", "renew", "release"))
    schema = "identity string, shard_id string, owner string, expires_at timestamp" if only_final else RESULTS
    return shard_ops.groupBy("identity", "shard_id").applyInPandas(run, schema)


def live_leases(leases: DataFrame, now: datetime) -> DataFrame:
    return leases.filter(F.col("expires_at") > F.lit(now).cast("timestamp"))


def workers(ops: DataFrame) -> DataFrame:
    """identity, owner and expires_at from heartbeats and deregistrations: the last of each owner counts."""
    rows = ops.filter(F.col("op").isin("heartbeat", "deregister"))
    expiry = F.timestamp_millis(F.unix_millis(F.col("now").cast("timestamp")) + F.coalesce("ttl_ms", F.lit(0)))
    last = rows.groupBy("identity", "owner").agg(F.max_by(F.struct("op", expiry.alias("expires_at")), "op_index").alias("l"))
    return last.filter("l.op = 'heartbeat'").select("identity", "owner", F.col("l.expires_at").alias("expires_at"))


def live_workers(table: DataFrame, now: datetime) -> DataFrame:
    return table.filter(F.col("expires_at") > F.lit(now).cast("timestamp")).orderBy("identity", "owner")


class Slots:
    """At most so many keys at a time, each once; 0 or less means no bound."""

    def __init__(self, most: int):
        self.most, self.held = most, set()

    def reserve(self, key: str) -> bool:
        if key in self.held or (self.most > 0 and len(self.held) >= self.most):
            return False
        self.held.add(key)
        return True

    def release(self, key: str) -> None:
        self.held.discard(key)


def acquire_all(store, shard_ids: list[str], most: int = 3, backoff: float = 1.0, sleep=time.sleep) -> list[str]:
    """Acquires several shards, each with ``most`` attempts a constant ``backoff`` apart; if one raises to the last, what was taken is given back."""
    taken: list[str] = []
    try:
        for shard_id in shard_ids:
            for attempt in range(1, most + 1):
                try:
                    if store.acquire(shard_id):
                        taken.append(shard_id)
                    break
                except Exception:
                    if attempt == most:
                        raise
                    sleep(backoff)
    except Exception:
        for shard_id in taken:
            store.release(shard_id)
        raise
    return taken
