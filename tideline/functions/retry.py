"""Classes of errors and delays before retries, as columns.

Three laws: linear (handlers and dead letters), constant (checkpoints and leases) and
doubling (reads and shard syncs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes of the stream service.
THROTTLED = ("ProvisionedThroughputExceededException", "LimitExceededException", "KMSThrottlingException")
RETRYABLE_CODES = ("ThrottlingException", "InternalFailure", "ServiceUnavailable", "RequestTimeout")
EXPIRED = "ExpiredIteratorException"
ALWAYS_FATAL = ("AccessDeniedException", "ResourceNotFoundException", "InvalidArgumentException", "ValidationException")
TRANSIENT_CLIENT = ("ThrottlingException", "LimitExceededException", "ProvisionedThroughputExceededException", "RequestTimeout", "RequestTimeoutException", "ExpiredNextTokenException")

READ_BASE, READ_CAP = 0.5, 10.0
SYNC_BASE, SYNC_CAP = 1.0, 30.0


def retryable_read(code: Column, fault: Column) -> Column:
    """``fault``: server, client, or network for errors without a code."""
    return F.coalesce(code.isin(*THROTTLED, *RETRYABLE_CODES) | fault.isin("server", "network"), F.lit(False))


def read_error_kind(code: Column) -> Column:
    return F.when(code == EXPIRED, "expired").when(code.isin(*THROTTLED, "ThrottlingException"), "throttle").otherwise("other")


def fatal_sync(code: Column, fault: Column) -> Column:
    client = (fault == "client") & ~code.isin(*TRANSIENT_CLIENT)
    return F.coalesce(code.isin(*ALWAYS_FATAL) | client, F.lit(False))


def doubling(n: Column, base: float, cap: float) -> Column:
    """Before retry n = 1, 2, ...: base * 2^(n-1), at most cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(n, F.lit(62)) - 1))


def with_jitter(delay: Column, share: Column, cap: Column) -> Column:
    """``share`` (0 to 1) of half the delay on top, and the cap again."""
    return F.least(cap, delay + delay * share / 2)


def sync_delay(n: Column, interval: float) -> Column:
    return F.least(doubling(n, SYNC_BASE, SYNC_CAP), F.lit(interval))


def linear_sleep(attempts: Column, backoff: float) -> Column:
    """All sleep of a handler that took so many attempts: backoff * (1 + 2 + ...) between them."""
    return F.lit(backoff) * attempts * (attempts - 1) / 2


def constant_sleep(attempts: Column, backoff: float) -> Column:
    return F.lit(backoff) * (attempts - 1)


def heartbeat_stale(last_success: Column, now: Column, interval_ms: int, ttl_ms: int) -> Column:
    """Fatal once a further interval would outlast the lease."""
    return F.unix_millis(now) >= F.unix_millis(last_success) + (ttl_ms - interval_ms)


def sync_stale(last_success: Column, now: Column, max_seconds: float) -> Column:
    return F.unix_micros(now) - F.unix_micros(last_success) > int(max_seconds * 1_000_000)
