"""Sequence numbers and checkpoint values as columns.

A sequence number is an unsigned decimal string that may exceed any numeric type; its
order is by length, then by characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SHARD_END


def order_key(c: Column) -> Column:
    return F.struct(F.length(c).alias("n"), c.alias("s"))


def after(seq: Column, bound: Column) -> Column:
    """Strictly after; everything is after a missing or empty bound."""
    longer = F.length(seq) > F.length(bound)
    return bound.isNull() | (bound == "") | longer | ((F.length(seq) == F.length(bound)) & (seq > bound))


def is_end(checkpoint: Column) -> Column:
    return F.coalesce(checkpoint.startswith(SHARD_END), F.lit(False))


def end_sequence(checkpoint: Column) -> Column:
    """The sequence number of an end mark, or the checkpoint itself; empty if there is none."""
    return F.when(is_end(checkpoint), F.regexp_replace(checkpoint, f"^{SHARD_END}:?", "")).otherwise(F.coalesce(checkpoint, F.lit("")))


def end_mark(seq: Column) -> Column:
    return F.when(F.coalesce(seq, F.lit("")) == "", F.lit(SHARD_END)).otherwise(F.concat(F.lit(SHARD_END + ":"), seq))


def advances(current: Column, new: Column) -> Column:
    """Whether ``new`` replaces ``current``: progress only goes forward, and an end is final."""
    return (
        F.when(new.isNull() | (new == ""), False)
        .when(current.isNull() | (current == ""), True)
        .when(current == new, False)
        .when(is_end(current), False)
        .when(is_end(new), True)
        .otherwise(after(new, current))
    )


def valid_stored(checkpoint: Column) -> Column:
    """What a store may hold: an end mark, or a decimal without leading zeros."""
    return is_end(checkpoint) | F.coalesce(checkpoint.rlike("^(0|[1-9][0-9]*)$"), F.lit(False))
