"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, computed with numpy on the bytes of many texts at once.
Training takes at most ``MOST_TRAINING`` labelled rows, those of the least hashes of
(doc_id), bins each statistic by quantiles and grows trees level by level from gradient
histograms.  The forest is flattened into arrays (feature, threshold, leaf), so scoring
is a fixed number of vectorised steps down complete trees.

Null and empty texts get statistics of 0 and the score these lead to.  Of labels that
repeat a doc_id the greatest counts; null labels don't.  Without labelled rows, every
score is 0.5.  Repeated documents each get their row.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, SOLID, Scratch, find_words, hash_spans, map_arrow, remainder, slices, text_bytes

MOST_TRAINING = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 5.0

_CLASS = np.zeros(256, np.uint8)  # lower, upper, digit, blank, line end, mark, not ASCII
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[:9], _CLASS[14:32] = 3, 4, 5, 5
_MARKS = b".,!?|*#$%&<>{}()[]=_-\"'/\\@:;"  # marks counted one by one
STATISTICS = [
    *(f"share_{c}" for c in ("lower", "upper", "digit", "blank", "line_end", "mark", "wide")), "log_bytes", "log_words", "word_length", "word_deviation", "long_words",
    "distinct_words", "distinct_pairs", "same_as_before", "first_upper", "end_mark", "line_bytes", "share_longest_run", *(f"mark_{m}" for m in _MARKS),
]


def statistics(array: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    data, offsets = text_bytes(array)
    n_docs, sizes = len(array), np.diff(offsets)
    out = np.zeros((n_docs, len(STATISTICS)), np.float32)
    if not len(data):
        return out
    doc_of_byte = np.repeat(np.arange(n_docs), sizes)
    kinds = np.bincount(doc_of_byte * 7 + _CLASS[data], minlength=n_docs * 7).reshape(n_docs, 7)
    bytes_ = np.maximum(sizes, 1)
    out[:, :7] = kinds / bytes_[:, None]
    out[:, 7] = np.log1p(sizes)
    starts, ends, firsts = find_words(data, offsets, SOLID)
    count = np.diff(firsts)
    words = np.maximum(count, 1)
    out[:, 8] = np.log1p(count)
    doc = np.repeat(np.arange(n_docs), count)
    if len(starts):
        length = (ends - starts).astype(np.float64)
        per = lambda v: np.bincount(doc, weights=v, minlength=n_docs) / words
        mean = per(length)
        out[:, 9] = mean
        out[:, 10] = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
        out[:, 11] = per(length > 12)
        h = hash_spans(_LOWER[data], starts, ends)
        inner = doc[1:] == doc[:-1]
        for column, keys, where in ((12, h, doc), (13, (h[:-1] * np.uint64(31) + h[1:])[inner], doc[1:][inner])):
            order = np.lexsort((keys, where))
            k, w = keys[order], where[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
            out[:, column] = np.bincount(w[new], minlength=n_docs) / words
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 14] = per(same)
        head, tail = data[starts], data[ends - 1]
        out[:, 15] = per((head >= 65) & (head <= 90))
        out[:, 16] = per(_CLASS[tail] == 5)
        runs = np.maximum.reduceat(np.append(length, 0), np.minimum(firsts[:-1], len(length)))
        out[:, 18] = np.where(count > 0, runs, 0) / bytes_
    out[:, 17] = np.log1p(sizes / (kinds[:, 4] + 1))
    place = np.full(256, -1)
    place[list(_MARKS)] = np.arange(len(_MARKS))
    at = place[data]
    some = at >= 0
    marks = np.bincount(doc_of_byte[some] * len(_MARKS) + at[some], minlength=n_docs * len(_MARKS))
    out[:, 19:] = marks.reshape(n_docs, -1) / bytes_[:, None]
    return out


class Forest:
    """Complete trees of one depth as arrays; node i of a level has children 2i+1 and 2i+2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin, features, thresholds, leaves = np.full(len(y), base), [], [], []
    columns = np.arange(n_features) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (n_features * BINS) + columns + binned).ravel()
            shape = (width, n_features, BINS)
            gs = np.bincount(key, np.repeat(g, n_features), width * n_features * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, n_features), width * n_features * BINS).reshape(shape).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (g_all - gs) ** 2 / (h_all - hs + L2) - g_all**2 / (h_all + L2)
            gain[(hs < LEAST_WEIGHT / 4) | (h_all - hs < LEAST_WEIGHT / 4)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g_leaf = np.bincount(node - inner, g, 2**DEPTH)
        h_leaf = np.bincount(node - inner, h, 2**DEPTH)
        leaf = -RATE * g_leaf / (h_leaf + L2)
        margin += leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, most_training: int = MOST_TRAINING) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    measured = scratch.keep(map_arrow(rows, measure, "doc_id long, x array<float>"), "statistics")
    held_out = remainder("doc_id", 3) == 1
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    least = marks.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most_training)
    sample = measured.join(least, "doc_id").orderBy("h", "doc_id").select("x", "y").limit(most_training).toPandas()
    x = np.array(sample["x"].tolist(), np.float32).reshape(len(sample), len(STATISTICS))
    forest = docs.sparkSession.sparkContext.broadcast(train(x, sample["y"].to_numpy(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            s = forest.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(measured.withColumn("held_out", held_out).select("doc_id", "held_out", "x"), score, "doc_id long, held_out boolean, score double, predicted int")
