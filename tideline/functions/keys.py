"""Keys of dead-lettered records and of stored coordination state, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of stored keys.
DLQ_KEY_VERSION = "kcg-dlq-v1"
DEFAULT_CHECKPOINT_PREFIX = "kinesis-checkpoint"
DEFAULT_LEASE_PREFIX = "kinesis-lease"
LEASE_SUFFIXES = {"lease_owners": "lease-owners", "lease_expirations": "lease-expirations", "workers": "workers"}


def idempotency_key(*fields: Column) -> Column:
    """SHA-256 over the fields, each after its length in bytes as a big-endian 64-bit integer."""
    framed = []
    for f in fields:
        text = F.coalesce(f, F.lit("")).cast("binary")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")), text]
    return F.concat(F.lit(DLQ_KEY_VERSION + ":"), F.sha2(F.concat(*framed), 256))


def base64url(text: Column) -> Column:
    """Base64 for URLs, without padding or line ends."""
    return F.translate(F.base64(F.coalesce(text, F.lit("")).cast("binary")), "+/=\r\n", "-_")


def escape_prefix(prefix: Column) -> Column:
    return F.replace(F.replace(F.replace(prefix, F.lit("%"), F.lit("%25")), F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))


def checkpoint_key(prefix: Column, identity: Column, shard_id: Column) -> Column:
    return F.concat_ws(":", escape_prefix(prefix), F.lit("v2"), base64url(identity), base64url(shard_id))


def lease_key(prefix: Column, identity: Column, kind: str) -> Column:
    tag = base64url(identity)
    tag = F.when(tag == "", F.lit("-")).otherwise(tag)
    return F.concat(escape_prefix(prefix), F.lit(":v2:{"), tag, F.lit("}:" + LEASE_SUFFIXES[kind]))


def lease_prefix(checkpoint_prefix: Column) -> Column:
    default = checkpoint_prefix.isNull() | checkpoint_prefix.isin("", DEFAULT_CHECKPOINT_PREFIX)
    return F.when(default, F.lit(DEFAULT_LEASE_PREFIX)).otherwise(F.concat(checkpoint_prefix, F.lit("-lease")))


def identity(group: Column, stream: Column) -> Column:
    return F.concat_ws(":", group, stream)
