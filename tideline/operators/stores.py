"""Checkpoint stores for work outside of a query: in memory, as a table in the shared folder, and with retries.

All have ``get`` (the empty string if there is none), ``save`` (advance-only, true if it
changed the store) and ``delete`` (the only way back; of nothing, too).  Keys are identity
and shard.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SHARD_END, InvalidStoredCheckpoint
from ..session import exists
from .checkpoints import merge_saves

_STORED = re.compile(r"0|[1-9][0-9]*")


def advances(stored: str, new: str) -> bool:
    """``seqnum.advances`` for plain strings; a stored value that no save can have left is an error."""
    if stored and not stored.startswith(SHARD_END) and not _STORED.fullmatch(stored):
        raise InvalidStoredCheckpoint(stored)
    if not new or new == stored or stored.startswith(SHARD_END):
        return False
    return not stored or new.startswith(SHARD_END) or (len(new), new) > (len(stored), stored)


class MemoryCheckpoints:
    def __init__(self):
        self.values: dict[tuple[str, str], str] = {}
        self.lock = threading.Lock()

    def get(self, identity: str, shard: str) -> str:
        with self.lock:
            return self.values.get((identity, shard), "")

    def save(self, identity: str, shard: str, value: str) -> bool:
        with self.lock:
            moves = advances(self.values.get((identity, shard), ""), value)
            if moves:
                self.values[identity, shard] = value
            return moves

    def delete(self, identity: str, shard: str) -> None:
        with self.lock:
            self.values.pop((identity, shard), None)


class TableCheckpoints:
    """A log of saves and deletes as Parquet below ``path``; one writer at a time.  ``table`` is what it comes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        schema = "identity string, shard_id string, arrival_index long, value string"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame:
        return merge_saves(self._log())

    def write(self, saves: DataFrame) -> None:
        """Adds many saves (identity, shard_id, value) at once; a null value deletes."""
        last = self._log().agg(F.coalesce(F.max("arrival_index"), F.lit(-1)).alias("last")).first()[0]
        saves.select("identity", "shard_id", F.lit(last + 1).cast("long").alias("arrival_index"), "value").write.mode("append").parquet(self.path)

    def get(self, identity: str, shard: str) -> str:
        found = self.table().filter((F.col("identity") == identity) & (F.col("shard_id") == shard)).first()
        return found.checkpoint if found else ""

    def save(self, identity: str, shard: str, value: str) -> bool:
        moves = advances(self.get(identity, shard), value)
        if moves:
            self.write(self.spark.createDataFrame([(identity, shard, value)], "identity string, shard_id string, value string"))
        return moves

    def delete(self, identity: str, shard: str) -> None:
        self.write(self.spark.createDataFrame([(identity, shard, None)], "identity string, shard_id string, value string"))


class Retrying:
    """A store whose calls are tried ``most`` times, a constant ``backoff`` apart; a corrupt value is raised at once."""

    def __init__(self, store, most: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.store, self.most, self.backoff, self.sleep = store, most, backoff, sleep

    def _call(self, name: str, *args: str):
        for attempt in range(1, self.most + 1):
            try:
                return getattr(self.store, name)(*args)
            except InvalidStoredCheckpoint:
                raise
            except Exception:
                if attempt == self.most:
                    raise
                self.sleep(self.backoff)

    def get(self, identity: str, shard: str) -> str:
        return self._call("get", identity, shard)

    def save(self, identity: str, shard: str, value: str) -> bool:
        return self._call("save", identity, shard, value)

    def delete(self, identity: str, shard: str) -> None:
        self._call("delete", identity, shard)
