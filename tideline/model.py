"""Schemas, options with their validation, and errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T

# Names that stored data and users of the wire formats rely on.
LATEST, TRIM_HORIZON, AT_TIMESTAMP, AFTER_SEQUENCE = "LATEST", "TRIM_HORIZON", "AT_TIMESTAMP", "AFTER_SEQUENCE_NUMBER"
SHARD_END = "SHARD_END"
FAIL_FAST, SKIP, SEND_TO_DLQ = "fail-fast", "skip", "send-to-dlq"
RECORD, BATCH = "record", "batch"

RECORDS = T.StructType([
    T.StructField("shard_id", T.StringType()),
    T.StructField("sequence_number", T.StringType()),
    T.StructField("partition_key", T.StringType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("approximate_arrival_timestamp", T.TimestampType()),
    T.StructField("encryption_type", T.StringType()),
])
SHARDS = "shard_id string, parent_shard_id string, adjacent_parent_shard_id string"
CHECKPOINTS = "identity string, shard_id string, checkpoint string"
CHECKPOINT_SAVES = "identity string, shard_id string, arrival_index int, value string"
LEASES = "identity string, shard_id string, owner string, expires_at timestamp"
WORKERS = "identity string, owner string, expires_at timestamp"
LEASE_OPS = "op_index int, identity string, now timestamp, op string, shard_id string, owner string, expected_owner string, ttl_ms long"
POISON = (
    "idempotency_key string, stream_name string, stream_arn string, consumer_group string, shard_id string, sequence_number string, partition_key string, "
    "approximate_arrival_timestamp timestamp, payload binary, error string, handler string, attempts int, failed_at timestamp, batch_size int, "
    "record_index_in_batch int, record_sequence_in_batch_order int"
)
EMISSIONS = "ts timestamp, name string, type string, value double, tags map<string,string>"


class EngineError(Exception):
    """Base of all errors of the engine."""


class NoShards(EngineError):
    """The stream has no shards."""


class Closed(EngineError):
    """The run has been closed."""


class AlreadyStarted(EngineError):
    """A run starts once."""


class HeartbeatStale(EngineError):
    """The last successful heartbeat is too old to trust the worker's leases."""


class ShardSyncStale(EngineError):
    """The shard listing has not been refreshed for too long."""


class HandlerPanic(EngineError):
    """A handler raised something that is no ordinary exception."""


class DrainTimeout(EngineError):
    """The run did not end in time."""


class HandlerFailed(EngineError):
    """A handler failed for good under fail-fast."""


class PublishFailed(EngineError):
    """A dead letter was not published; names what the handler and the publisher raised."""


class NotOwned(EngineError):
    """The lease is not held by this owner."""


class InvalidStoredCheckpoint(EngineError):
    """A stored checkpoint is neither a decimal nor an end mark."""


_SEGMENT = re.compile(r"[A-Za-z0-9_.-]+\Z")


def check_segment(what: str, value: str) -> str:
    if len(value) > 128:
        raise ValueError(f"{what}: at most 128 characters")
    if not _SEGMENT.match(value):
        raise ValueError(f"{what}: only letters, digits, '.', '_' and '-'")
    return value


def stream_name_of_arn(arn: str) -> str:
    """The stream's name in arn:partition:kinesis:region:account:stream/name."""
    parts = arn.split(":", 5)
    if len(parts) != 6 or parts[0] != "arn":
        raise ValueError("not an ARN")
    _, partition, service, region, account, resource = parts
    if service != "kinesis" or not resource.startswith("stream/"):
        raise ValueError("not the ARN of a stream")
    if not partition or not region or not re.fullmatch(r"[0-9]{12}", account):
        raise ValueError("the ARN needs a partition, a region and an account of 12 digits")
    return check_segment("stream name in ARN", resource[len("stream/") :])


@dataclass(frozen=True)
class StreamConfig:
    consumer_group: str
    stream_name: str = ""
    stream_arn: str = ""
    start_position: str = LATEST
    start_timestamp: datetime | None = None

    def __post_init__(self) -> None:
        if bool(self.stream_name) == bool(self.stream_arn):
            raise ValueError("exactly one of stream name and ARN")
        if not self.consumer_group:
            raise ValueError("a consumer group is needed")
        check_segment("consumer group", self.consumer_group)
        self.name  # noqa: B018  validates
        if self.start_position not in ("", LATEST, TRIM_HORIZON, AT_TIMESTAMP):
            raise ValueError(f"start position {self.start_position!r}")
        if self.start_position == AT_TIMESTAMP and self.start_timestamp is None:
            raise ValueError("AT_TIMESTAMP needs a timestamp")

    @property
    def name(self) -> str:
        return check_segment("stream name", self.stream_name) if self.stream_name else stream_name_of_arn(self.stream_arn)

    @property
    def identity(self) -> str:
        return f"{self.consumer_group}:{self.name}"


@dataclass(frozen=True)
class Tuning:
    """Seconds, where a time is meant, but for the heartbeat, which is in milliseconds.  Defaults are fixed values."""

    shard_concurrency: int = 1
    batch_size: int = 100
    poll_interval: float = 1.0
    idle_between_reads: float = 0.2
    shard_sync_interval: float = 60.0
    shard_sync_max_staleness: float = 0.0
    retry_max_attempts: int = 3
    retry_backoff: float = 1.0
    checkpoint_every: int = 100
    rebalance_interval_min: float = 10.0
    rebalance_interval_jitter: float = 10.0
    heartbeat_interval_ms: int = 5_000
    heartbeat_ttl_ms: int = 20_000
    lease_release_timeout: float = 5.0
    shard_cooldown: float = 10.0
    publish_max_attempts: int = 3
    publish_backoff: float = 1.0
    publish_timeout: float = 10.0
    max_moves: int = 2
    max_shards: int = 0  # no bound

    def __post_init__(self) -> None:
        rules = {
            "batch_size must be 1 to 10000": 1 <= self.batch_size <= 10_000,
            "shard_concurrency must be at least 1": self.shard_concurrency >= 1,
            "poll_interval must be positive": self.poll_interval > 0,
            "idle_between_reads can't be negative": self.idle_between_reads >= 0,
            "shard_sync_interval must be at least 1 s": self.shard_sync_interval >= 1,
            "shard_sync_max_staleness can't be below the interval": self.shard_sync_max_staleness == 0 or self.shard_sync_max_staleness >= self.shard_sync_interval,
            "retry_max_attempts must be at least 1": self.retry_max_attempts >= 1,
            "retry_backoff must be positive": self.retry_backoff > 0,
            "checkpoint_every must be at least 1": self.checkpoint_every >= 1,
            "rebalance_interval_min must be positive": self.rebalance_interval_min > 0,
            "rebalance_interval_jitter can't be negative": self.rebalance_interval_jitter >= 0,
            "heartbeat times are whole milliseconds": isinstance(self.heartbeat_interval_ms, int) and isinstance(self.heartbeat_ttl_ms, int),
            "heartbeat_interval_ms must be at least 1": self.heartbeat_interval_ms >= 1,
            "heartbeat_ttl_ms must be three intervals at least": self.heartbeat_ttl_ms >= 3 * self.heartbeat_interval_ms,
            "lease_release_timeout must be positive": self.lease_release_timeout > 0,
            "shard_cooldown must be positive": self.shard_cooldown > 0,
            "publish_max_attempts must be at least 1": self.publish_max_attempts >= 1,
            "publish_backoff can't be negative": self.publish_backoff >= 0,
            "publish_timeout must be positive": self.publish_timeout > 0,
            "max_moves must be at least 1": self.max_moves >= 1,
        }
        for rule, holds in rules.items():
            if not holds:
                raise ValueError(rule)

    @property
    def max_staleness(self) -> float:
        """How old a shard listing may get: ten intervals, if not set."""
        return self.shard_sync_max_staleness or 10 * self.shard_sync_interval


@dataclass(frozen=True)
class HandlerOptions:
    kind: str = RECORD
    policy: str = FAIL_FAST
    has_publisher: bool = False
    tuning: Tuning = field(default_factory=Tuning)

    def __post_init__(self) -> None:
        if self.kind not in (RECORD, BATCH):
            raise ValueError("a record or a batch handler")
        if self.policy not in (FAIL_FAST, SKIP, SEND_TO_DLQ):
            raise ValueError(f"failure policy {self.policy!r}")

    @property
    def effective_policy(self) -> str:
        return FAIL_FAST if self.policy == SEND_TO_DLQ and not self.has_publisher else self.policy


def one_handler(on_record, on_batch) -> str:
    """The kind of the one handler that is given."""
    if (on_record is None) == (on_batch is None):
        raise ValueError("exactly one of a record handler and a batch handler")
    return RECORD if on_record is not None else BATCH
