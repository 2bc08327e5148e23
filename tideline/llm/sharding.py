"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, text crc, size).  A Feistel network of
``ROUNDS`` rounds permutes the smallest power of four that holds n; numbers that leave
0..n-1 are permuted again until they return (cycle walking), which gives a permutation of
0..n-1.  Row p of the shuffled order lies in shard ``p % shards`` at slot ``p // shards``,
so shard sizes differ by one at most, slots have no gap, and the place of any row number
is computed from (n, shards, seed) alone.

``write_shards`` writes whole documents so.

Null texts have no bytes; equal rows get different numbers; a null ``doc_id`` comes
first.  An empty table gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, map_arrow, mix, running_sums

ROUNDS = 6
SHARD, SLOT = "_shard", "_slot"  # columns of written shards, beside the documents' own


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each row number in the shuffled order of ``n`` rows."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    half, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = numbers.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        out[todo] = (left << half) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, scratch: Scratch, shards: int = 8, seed: int = 0, keep: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row; ``keep`` names columns to carry along, as _keep_0, _keep_1, ...."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    kept = [column(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("one"), *kept)
    numbered = running_sums(rows, ["doc_id", "text_crc32", "size"], {"row_number": "one"}, scratch, "rows").drop("one")
    n = numbered.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*batch.schema.names, "shard", "slot"])

    return map_arrow(numbered, place, T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def write_shards(docs: DataFrame, scratch: Scratch, path: str, shards: int = 8, seed: int = 0, slots_in_file: int = 1 << 20) -> DataFrame:
    """Writes the documents, with all their columns, in shuffled order and returns them as read back, with shard and slot.

    A shard is a folder ``_shard=<k>`` of files of about ``slots_in_file`` consecutive slots,
    rows ascending by slot; a file is one task's, so no task need hold a whole shard.
    """
    placed = shard_rows(docs, scratch, shards, seed, docs.columns)
    out = placed.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("shard").alias(SHARD), F.col("slot").alias(SLOT))
    part = F.floor(F.col(SLOT) / slots_in_file)
    files = max(1, -(-out.count() // (shards * slots_in_file))) * shards
    dealt = out.withColumn("__part", part).repartitionByRange(files, SHARD, "__part", SLOT).sortWithinPartitions(SHARD, SLOT).drop("__part")
    dealt.write.mode("overwrite").partitionBy(SHARD).parquet(path)
    return docs.sparkSession.read.parquet(path)
