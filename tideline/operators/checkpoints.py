"""Checkpoints: merging a log of saves, when saves are due, and the store itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seqnum
from ..model import InvalidStoredCheckpoint


def merge_saves(saves: DataFrame) -> DataFrame:
    """identity, shard_id and the checkpoint left by advance-only saves in ``arrival_index`` order.

    The first end mark wins for good; before one, the greatest sequence number.  Rows with
    ``value`` null are deletes, which let progress start anew.  Plain aggregates, combined
    before the shuffle; a log meets the last deletes of its shards in a join.
    """
    by = ["identity", "shard_id"]
    deletes = saves.filter(F.col("value").isNull()).groupBy(*by).agg(F.max("arrival_index").alias("_deleted"))
    rows = saves.join(deletes, by, "left").filter(F.col("_deleted").isNull() | (F.col("arrival_index") > F.col("_deleted")))
    value = F.col("value")
    real = rows.filter(value.isNotNull() & (value != ""))
    end = F.min_by(F.when(seqnum.is_end(value), value), F.when(seqnum.is_end(value), F.col("arrival_index")))
    key = F.when(~seqnum.is_end(value), seqnum.order_key(value))
    return real.groupBy(*by).agg(end.alias("e"), F.max(key).alias("m")).select(*by, F.coalesce("e", F.col("m.s")).alias("checkpoint"))


def apply_saves(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """``stored`` checkpoints with later saves merged in."""
    first = stored.select("identity", "shard_id", F.lit(-1).alias("arrival_index"), F.col("checkpoint").alias("value"))
    return merge_saves(first.unionByName(saves.select("identity", "shard_id", "arrival_index", "value")))


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone, ["identity", "shard_id"], "left_anti")


def validate(stored: DataFrame) -> DataFrame:
    """``stored`` as it is; fails on a value that no save can have left."""
    bad = stored.filter(~seqnum.valid_stored(F.col("checkpoint"))).limit(1).collect()
    if bad:
        raise InvalidStoredCheckpoint(str(bad[0].asDict()))
    return stored


def due_pages(progress: DataFrame, every: int, held: DataFrame | None = None) -> DataFrame:
    """With ``due`` (whether a save is made at the end of the page), ``held`` (records since the last save) and ``last`` (the shard's last page here).

    The count of records since the last save is kept page by page; at ``every`` or more,
    or after a published dead letter, the page's end is saved and the count begins at 0
    again.  ``held`` (shard_id, held) carries counts over from an earlier run.  That depends
    on the order, so each shard's pages are walked in order; a task keeps one count, whatever
    the number of pages, and walks page summaries, not records.
    """
    rows = progress.select("shard_id", F.col("page_no").cast("int").alias("page_no"), F.col("n").cast("long").alias("n"), "last_seq", F.coalesce("flush", F.lit(False)).alias("flush"))
    if held is not None:
        first = held.select("shard_id", F.lit(-1).alias("page_no"), F.col("held").cast("long").alias("n"), F.lit(None).cast("string").alias("last_seq"), F.lit(False).alias("flush"))
        rows = rows.unionByName(first)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, count, kept = None, 0, []  # kept: the row of which it is not known yet whether it is the last

        def emit(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_WALKED.types)], names=_WALKED.names)

        for batch in batches:
            out = []
            for s, page, n, last_seq, flush in zip(*(batch.column(c).to_pylist() for c in ("shard_id", "page_no", "n", "last_seq", "flush"))):
                if s != shard:
                    shard, count = s, 0
                    for row in kept:
                        row[6] = True
                out += kept
                kept = []
                count += n
                if page < 0:
                    continue
                due = flush or count >= every
                count = 0 if due else count
                kept = [[s, page, n, last_seq, due, count, False]]
            if out:
                yield emit(out)
        for row in kept:
            row[6] = True
        if kept:
            yield emit(kept)

    return rows.repartition("shard_id").sortWithinPartitions("shard_id", "page_no").mapInArrow(walk, "shard_id string, page_no int, n long, last_seq string, due boolean, held long, last boolean")


_WALKED = pa.schema([("shard_id", pa.string()), ("page_no", pa.int32()), ("n", pa.int64()), ("last_seq", pa.string()), ("due", pa.bool_()), ("held", pa.int64()), ("last", pa.bool_())])


def saves_of(progress: DataFrame, every: int, identity: str, drained: bool = False, closed: DataFrame | None = None) -> DataFrame:
    """The save log of a run: due pages; with ``drained`` also each shard's last page; an end mark for ``closed`` shards.

    A shard that closes while draining gets no end mark.
    """
    return saves_of_walked(due_pages(progress, every), identity, drained, closed)


def saves_of_walked(walked: DataFrame, identity: str, drained: bool = False, closed: DataFrame | None = None) -> DataFrame:
    saves = walked.filter(F.col("due") | (F.lit(drained) & F.col("last")))
    out = saves.select(F.lit(identity).alias("identity"), "shard_id", (F.col("page_no") * 2).cast("int").alias("arrival_index"), F.col("last_seq").alias("value"))
    if closed is not None and not drained:
        ends = walked.filter("last").join(closed, "shard_id", "left_semi")
        out = out.unionByName(ends.select(F.lit(identity).alias("identity"), "shard_id", (F.col("page_no") * 2 + 1).cast("int").alias("arrival_index"), seqnum.end_mark(F.col("last_seq")).alias("value")))
    return out
