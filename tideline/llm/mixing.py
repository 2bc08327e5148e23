"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

A source's documents, in a shuffled order, form one stream of words that is cut into
blocks of ``block`` words, or of 1/``LEAST_SLOTS`` of its target where that is less.  A
source has as many slots as its blocks need to give its target; the last slot is cut to
what is left, so a source takes its target, rounded up to words, whatever its size.  Slot
i has the golden-ratio point frac((i + 1/2) * phi), in 64-bit integers; the points' ranks map through the
sources' cumulative numbers of slots, so every stretch of slots comes near the targets.
The r-th slot of a source takes block r modulo its blocks: a source that is asked for more
than it has repeats in whole passes.  Joining slots and documents by source and block
gives the mix: pieces of documents in the order of slots.

Places and ranks are sums over ordered tables (``running_sums``), so neither a hot source
nor many sources meet in one task: a document's place in its source's stream is a running
sum over (source, hash) less the sum before its source, a slot's rank the same over
(source, slot), and points' ranks are matched with slots by one ordering of both.  The
join is by source and block, of which each holds ``block`` words at most and a few slots.

Targets: a source's share of all words by weight, stopped at ``MOST_PASSES`` times its
size; what is above goes to the others by weight until none is above.

A null text has no words; a source without words has target 0 and takes nothing, and so
do documents without words.  The null source comes last.  Repeated documents each get
their row.  Without any words nothing is taken; an empty table gives an empty table.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, Scratch, column, find_words, map_arrow, running_sums, slices, text_bytes

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
GOLDEN = 0x9E3779B97F4A7C15  # the golden ratio's fraction of 2^64
SLOTS, LEAST_BLOCK, MOST_BLOCK = 1 << 16, 1, 1_024  # blocks hold words / SLOTS words, within these
LEAST_SLOTS = 8  # of a source with as many words to take


def document_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("string"), docs["text"].cast("string"))


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id (null if not an integer), source, size, and a key that shuffles: a hash of doc_id, of whatever type, and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(find_words(data, offsets, SOLID)[2]))], names=["doc_id", "source", "key", "size"])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("source").cast("string"), document_key(docs).alias("key"), F.col("text").cast("string"))
    return map_arrow(rows, count, "doc_id long, source string, key long, size long")


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, place (in order of sources), start (words of the sources before), target, and words (the target in whole words)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumns({"null_last": F.col("source").isNull().cast("int"), "one": F.lit(1).cast("long")})
    placed = running_sums(by_source, ["null_last", "source"], {"place": "one", "start": "source_size"}, scratch, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    rated = placed.select("source", "source_size", "place", "start", weight.alias("weight"))
    total = rated.agg(F.sum("source_size")).first()[0] or 0
    cap, rate = F.col("source_size") * MOST_PASSES, 0.0
    while True:  # words for each unit of weight; each turn stops further sources or ends
        full = cap <= F.col("weight") * rate
        got = rated.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (got[0] or 0)) / got[1] if got[1] else rate
        if new <= rate:
            break
        rate = new
    target = F.least(cap.cast("double"), F.col("weight") * rate)
    return rated.select("source", "source_size", "place", "start", target.alias("target"), F.ceil(target).cast("long").alias("words"))


def block_words(total: int) -> int:
    return int(min(max(total // SLOTS, LEAST_BLOCK), MOST_BLOCK))


def own_block(words, block: int):
    """The words in a block of a source that is to take ``words``."""
    return F.greatest(F.least(F.floor(words / LEAST_SLOTS), F.lit(block)), F.lit(1)).cast("long")


def slot_plan(shares: DataFrame, block: int) -> DataFrame:
    """The shares with each source's block size (``own``), blocks in a pass, slots, and words of its last slot."""
    size, own, words = F.col("source_size"), F.col("own"), F.col("words")
    over = F.when(size > 0, words % size).otherwise(0)  # words beyond whole passes
    cut = F.ceil(over / own).cast("long")
    end = F.when(over > 0, over - (cut - 1) * own).otherwise(size - (F.col("blocks") - 1) * own)
    planned = shares.withColumn("own", own_block(words, block)).withColumn("blocks", F.ceil(size / own).cast("long"))
    return planned.withColumns({"slots": F.when(size > 0, F.floor(words / size) * F.col("blocks") + cut).otherwise(0).cast("long"), "end": end.cast("long")})


def slot_edges(shares: DataFrame, scratch: Scratch) -> DataFrame:
    """The shares that have slots, with ``first`` (slots of those before) and ``passed`` (how many come before)."""
    some = shares.withColumn("has", (F.col("slots") > 0).cast("long"))
    edges = running_sums(some, ["place"], {"first": "slots", "passed": "has"}, scratch, "edges").drop("has")
    return scratch.keep(edges.filter("slots > 0"), "slot-edges")


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch.column("id").to_numpy()
        at = slot.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN // 2)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((at ^ np.uint64(1 << 63)).view(np.int64)), pa.array(np.ones(len(slot), np.int64))], names=["slot", "at", "one"])


def schedule(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """slot, at (its point, of 64 bits) and place: which source each slot takes."""
    total = edges.agg(F.sum("slots")).first()[0] or 0
    points = map_arrow(edges.sparkSession.range(total), _points, "slot long, at long, one long")
    points = running_sums(points, ["at", "slot"], {"number": "one"}, scratch, "point-ranks").select("slot", "at", "number", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("step"))
    marks = edges.select(F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("at"), F.col("first").alias("number"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("step"))
    ranked = running_sums(points.unionByName(marks), ["number", "kind"], {"passed": "step"}, scratch, "points")
    # a rank's source is the last mark passed
    return ranked.filter("kind = 1").select("slot", "at", (F.col("passed") - 1).alias("passed")).join(edges.select("place", "passed"), "passed").select("slot", "at", "place")


def ranked(slots: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """slot, place, rank (the slot's number among its source's), the block that it takes, and where in the stream it stops at most."""
    ordered = running_sums(slots.select("place", "slot", F.lit(1).cast("long").alias("one")), ["place", "slot"], {"number": "one"}, scratch, "ranks")
    rows = ordered.join(edges.select("place", "own", "blocks", "slots", "end", "first"), "place").withColumn("rank", F.col("number") - F.col("first"))
    block = F.col("rank") % F.col("blocks")
    words = F.when(F.col("rank") == F.col("slots") - 1, F.col("end")).otherwise(F.col("own"))
    return rows.select("slot", "place", "rank", block.alias("block"), (block * F.col("own") + words).alias("stop"))


def place_documents(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream (``at``), and the sources with their targets."""
    counted = count_words(docs).withColumn("null_last", F.col("source").isNull().cast("int"))
    sizes = running_sums(counted, ["null_last", "source", "key", "doc_id"], {"total_before": "size"}, scratch, "sizes")
    shares = scratch.keep(targets(sizes, scratch, weights), "shares")
    starts = shares.select(F.col("source").alias("s"), "source_size", "place", "target", "start")
    rows = sizes.join(starts, F.col("source").eqNullSafe(F.col("s")))
    placed = rows.select("doc_id", "key", "source", "size", "source_size", "target", "place", (F.col("total_before") - F.col("start")).alias("at"))
    return scratch.keep(placed, "placed"), shares


def mix_pieces(placed: DataFrame, shares: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """The mix: slot, place, at (which document of the source), first and last word (exclusive) of the piece within it."""
    edges = slot_edges(slot_plan(shares, block), scratch)
    slots = scratch.keep(ranked(scratch.keep(schedule(edges, scratch), "slots"), edges, scratch), "ranked")
    end, own = F.col("at") + F.col("size"), F.col("own")
    sized = placed.filter("size > 0").withColumn("own", own_block(F.ceil("target").cast("long"), block))
    spread = sized.select("place", "at", "size", "own", F.explode(F.sequence(F.floor(F.col("at") / own), F.floor((end - 1) / own))).alias("block"))
    low, high = F.greatest(F.col("at"), F.col("block") * own), F.least(end, (F.col("block") + 1) * own)
    pieces = spread.select("place", "block", "at", low.alias("low"), high.alias("high"))
    joined = slots.join(pieces, ["place", "block"]).filter("low < stop")
    return joined.select("slot", "place", "at", (F.col("low") - F.col("at")).alias("first"), (F.least("high", "stop") - F.col("at")).alias("last"))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, block: int | None = None) -> DataFrame:
    """Per document: source, size, source_size, target, taken (words), and passes: how often its first word is taken."""
    placed, shares = place_documents(docs, scratch, weights)
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    pieces = mix_pieces(placed, shares, scratch, block or block_words(total))
    taken = pieces.groupBy("place", "at").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.count_if(F.col("first") == 0).alias("passes"))
    taken = taken.select(F.col("place").alias("p"), F.col("at").alias("a"), "taken", "passes")
    rows = placed.join(taken, (F.col("size") > 0) & (F.col("place") == F.col("p")) & (F.col("at") == F.col("a")), "left")
    return rows.select("doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("passes", F.lit(0)).cast("int").alias("passes"))


def mix_documents(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS) -> DataFrame:
    """The documents of the mix, whole: each as often as the block of its first word is taken.

    A source's slots go through its stream in whole passes and then once more from its
    beginning, and the stream is in the order of keys.  So of each source all documents up
    to some key are taken once more often than those after it, and the decisions that the
    mix has made are handed to the documents as one row per source: texts are not shuffled.
    """
    levels = mix(docs, scratch, weights).filter("size > 0").groupBy("source", "passes").agg(F.max("key").alias("last"))
    levels = levels.groupBy(F.col("source").alias("__mix_source")).agg(F.max("passes").alias("__mix_top"), F.max_by("last", "passes").alias("__mix_last"), F.min("passes").alias("__mix_rest"))
    levels = scratch.keep(levels, "levels")
    scratch.drop_all_but("levels")
    times = F.when(document_key(docs) <= F.col("__mix_last"), F.col("__mix_top")).otherwise(F.col("__mix_rest"))
    has_words = docs["text"].cast("string").rlike(r"[^\x20\x09-\x0D]")
    turns = docs.filter(has_words).join(levels, docs["source"].cast("string").eqNullSafe(F.col("__mix_source")))
    turns = turns.withColumn("__mix_times", times).filter("__mix_times > 0").withColumn("__mix_turn", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return turns.select(*[column(c) for c in docs.columns])
