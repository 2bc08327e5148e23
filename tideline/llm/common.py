"""Helpers shared by the operators: scratch tables, running sums, byte-level words.

Words are found and hashed on whole Arrow batches with numpy: the UTF-8 bytes of
all texts of a slice lie in one buffer, and documents are told apart by offsets.
A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19  # text that one numpy pass takes at once, unless one text is longer
BATCH_BYTES = 1 << 20  # of an Arrow batch that goes to a worker, unless the session sets another bound
_LOCAL_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str):
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes: rows alone are no bound where texts are long.

    The bound is a setting of the session and stays there; one that is set already is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class Carried:
    """Columns of ``docs`` that go along with a pass over its texts, as _keep_0, _keep_1, ...; the text is sent once."""

    def __init__(self, docs: DataFrame, names: list[str]):
        kinds = [docs.schema[c].dataType for c in names]
        self.is_text = [c == "text" and isinstance(k, T.StringType) for c, k in zip(names, kinds)]
        self.fields = [T.StructField(f"_keep_{i}", k, True) for i, k in enumerate(kinds)]
        self.names = [f.name for f in self.fields]
        self.sources = list(names)

    def columns(self) -> list:
        return [column(c).alias(k) for c, k, same in zip(self.sources, self.names, self.is_text) if not same]

    def arrays(self, texts: pa.Array, rest: list[pa.Array]) -> list[pa.Array]:
        """The carried columns of a batch from its texts and those that ``columns()`` selected."""
        others = iter(rest)
        return [texts if same else next(others) for same in self.is_text]


def small_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """A few rows of the driver as a table; by way of Arrow, which needs no Python workers."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


# --------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_ROOT:
        _LOCAL_ROOT[key] = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return _LOCAL_ROOT[key]


_WRITTEN: dict[str, list] = {}  # by application: scratch folders


def clean(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; results that still read them must have been written before."""
    for scratch in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        scratch.drop("")


class Scratch:
    """Tables written to the shared folder and read back: a cut in the lineage that outlives executors.

    A result may read them as long as it lives, so they stay until they are dropped, or until ``clean``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, set()
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def keep(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(_nullable(df.schema)).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        """Drops what a result no longer needs."""
        self.drop(*sorted(self.names - {*names}))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


class HashFilter:
    """Which 64-bit hashes may be in a set: 16 bits for each, within bounds; a few pass by chance, ever more beyond the bound."""

    LEAST, MOST = 1 << 20, 1 << 27  # bits

    def __init__(self, hashes: DataFrame):
        """``hashes``: one column."""
        name, n = hashes.columns[0], hashes.count()
        self.bits = min(max(1 << (16 * n).bit_length(), self.LEAST), self.MOST)
        slots = hashes.select(F.pmod(name, F.lit(self.bits)).cast("int").alias("s"))
        got = slots.groupBy(F.expr("s div 64").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, s % 64))").alias("b")).toArrow()
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % self.bits
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


# ------------------------------------------------------------------ running sums


def running_sums(df: DataFrame, order: list, sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with, for each entry ``new: column`` of ``sums``, the sum of ``column`` over all rows before.

    Rows are dealt by ranges of ``order`` and summed within each partition; only one
    total per partition goes to the driver.  Rows that tie in ``order`` get some order
    among themselves, fixed by the written table.  Nulls count 0 and sort first.
    """
    fields = [T.StructField(f"_{c}", T.LongType()) for c in sums]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *fields])
    columns = list(sums.values())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), [0] * len(columns)
        for batch in batches:
            arrays = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32))]
            for i, c in enumerate(columns):
                v = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                arrays.append(pa.array(total - v + before[i]))
                before[i] += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = scratch.keep(map_arrow(dealt, local, schema), name)
    totals = kept.groupBy("_part").agg(*[F.sum(c).alias(f"t{i}") for i, c in enumerate(columns)])
    rows = sorted(totals.collect())  # one per partition
    bases, at = [], [0] * len(columns)
    for row in rows:
        bases.append((row[0], *at))
        at = [a + (t or 0) for a, t in zip(at, row[1:])]
    base = small_table(df.sparkSession, pa.schema([("_part", pa.int32()), *[(f"_b{i}", pa.int64()) for i in range(len(columns))]]), bases)
    out = kept.join(F.broadcast(base), "_part")
    return out.select(*df.columns, *[(F.col(f"_{c}") + F.col(f"_b{i}")).alias(c) for i, c in enumerate(sums)])


# ------------------------------------------------------------------ text as bytes


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array in one buffer, and the offsets of its texts."""
    if array.null_count:
        array = array.fill_null("")
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text at most, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def cut_long(array: pa.Array, may_cut: Callable[[np.ndarray], np.ndarray], most: int = SLICE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The texts with those of more than ``most`` bytes cut into pieces, and the first piece of each text (and their number).

    ``may_cut`` tells for bytes which of them, but the first and the last, may begin a piece; where none may, a piece gets longer.
    """
    data, offsets = text_bytes(array)
    long = np.flatnonzero(np.diff(offsets) > most)
    if not len(long):
        return array, np.arange(len(array) + 1)
    edges = [offsets]
    for i in long:
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > most:
            lo, hi = at, min(at + most, end)
            found = np.flatnonzero(may_cut(data[lo:hi])) + lo
            while not len(found[found > at]) and hi < end:
                lo, hi = hi - 2, min(hi + most, end)
                found = np.flatnonzero(may_cut(data[lo:hi])) + lo
            found = found[found > at]
            if not len(found):
                break
            at = int(found[-1] if hi == min(at + most, end) else found[0])
            edges.append(np.array([at]))
    cut = np.sort(np.concatenate(edges), kind="stable")
    pieces = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
    inner = np.sort(np.concatenate([e for e in edges[1:]])) if len(edges) > 1 else np.zeros(0, np.int64)
    return pieces, np.arange(len(offsets)) + np.searchsorted(inner, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)  # a-z, 0-9 and all that is not ASCII
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
SOLID = np.ones(256, bool)  # all but blanks
SOLID[[9, 10, 11, 12, 13, 32]] = False

_ODD, _GOLD = 0x9E3779B97F4A7C55, np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for key, m in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of ``kind`` within each text, and the index of each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD)
        at = to
    return out


def word_hashes(array: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z in lower case, and the index of each text's first word."""
    data, offsets = text_bytes(array)
    data = _LOWER[data]
    starts, ends, firsts = find_words(data, offsets, kind)
    return hash_spans(data, starts, ends), firsts


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` consecutive words; entry i begins at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += words[j : j + n] * np.uint64(m)
        m = m * _ODD % (1 << 64)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1 of all i, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def remainder(column: str, m: int):
    """crc32 of a column as text, modulo ``m`` (null as the empty text): splits learned from held-out rows."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m
