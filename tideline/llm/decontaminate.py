"""Benchmark decontamination by winnowing.

Each text keeps, of every ``WINDOW`` consecutive hashes of ``K`` words, the least ones.
Two texts that share ``WINDOW + K - 1 = SPAN`` consecutive words therefore keep a common
fingerprint at the same place of the shared passage, so looking up the fingerprints of
documents among those of the benchmark misses no such passage.  A match is extended to
the ``WINDOW`` windows of ``SPAN`` words around it; those that some item has are hits,
and windows that follow one another make up longer passages.  Items of fewer than
``SPAN`` words are looked up by the hash of all their words.

A window is looked up once however often it stands in a text or an item, so work and
memory follow the number of words, also in texts that repeat a few words over and over;
(document, item) pairs are gathered in blocks of ``BLOCK_PAIRS``.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_WORDS`` words, of
which each is broadcast, and the documents pass all blocks without a shuffle.

Null and empty texts have no words and no hits; items without words are never found.  A
null ``item_id`` counts as the empty string; rows with the same ``item_id`` are one item
with the windows of all.  Repeated documents each get their row.  Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Carried, map_arrow, ragged, shingles, slices, word_hashes

K, WINDOW, SPAN = 5, 6, 10
BLOCK_WORDS, BLOCK_PAIRS, GATHERED_BYTES = 2_000_000, 1_000_000, 16 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(grams: np.ndarray, firsts: np.ndarray, n_words: int) -> np.ndarray:
    """Places of the fingerprints among the ``K``-grams; ``firsts`` are the first words of the texts."""
    n = n_words - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, grams[j : j + n], out=least)
    whole = np.ones(n, bool)  # the window lies within one text
    for j in range(1, SPAN):
        cut = firsts[1:-1] - j
        whole[cut[(cut >= 0) & (cut < n)]] = False
    keep = np.zeros(len(grams), bool)
    for j in range(WINDOW):
        keep[j : j + n] |= whole & (grams[j : j + n] == least)
    return np.flatnonzero(keep)


class Index:
    """Fingerprints of a block of items, and the items of each of their windows."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        self.ids = ids
        words, firsts = word_hashes(pa.array(texts, pa.string()), ALNUM)
        sizes = np.diff(firsts)
        grams = shingles(words, K)
        self.prints = np.unique(grams[winnow(grams, firsts, len(words))])
        self.by_length = {}  # windows of so many words: their hashes, where each one's items begin, the items
        for n in range(1, SPAN + 1):
            some = np.flatnonzero(sizes >= SPAN if n == SPAN else sizes == n)
            if len(some):
                count = sizes[some] - n + 1
                h, item = shingles(words, n)[ragged(firsts[some], count)], np.repeat(some, count)
                order = np.lexsort((item, h))
                h, item = h[order], item[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
                h, item = h[new], item[new].astype(np.int32)
                distinct, starts = np.unique(h, return_index=True)
                self.by_length[n] = (distinct, np.append(starts, len(h)), item)

    def hits(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents' words: which are hit; and pairs (document, item) as rows."""
        hit, pairs = np.zeros(len(words) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for n, (hashes, starts, items) in self.by_length.items():
            own = shingles(words, n)
            at = self._around_prints(words, firsts, len(own)) if n == SPAN else np.arange(len(own))
            place = np.minimum(np.searchsorted(hashes, own[at]), len(hashes) - 1)
            found = hashes[place] == own[at]
            at, place = at[found], place[found]
            doc = np.searchsorted(firsts, at, side="right") - 1
            inside = at + n <= firsts[doc + 1]
            at, place, doc = at[inside], place[inside], doc[inside]
            hit[at] += 1  # no place comes twice
            hit[at + n] -= 1
            once = np.unique(doc * len(hashes) + place)
            doc, place = once // len(hashes), once % len(hashes)
            count = starts[place + 1] - starts[place]
            total, lo = np.cumsum(count), 0
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_PAIRS, side="right")))
                block = np.repeat(doc[lo:hi], count[lo:hi]) * len(self.ids) + items[ragged(starts[place[lo:hi]], count[lo:hi])]
                block = np.unique(block)
                pairs.append(np.stack([block // len(self.ids), block % len(self.ids)], 1))
                lo = hi
        return np.cumsum(hit)[:-1] > 0, np.unique(np.concatenate(pairs), axis=0)

    def _around_prints(self, words: np.ndarray, firsts: np.ndarray, n_windows: int) -> np.ndarray:
        """Where windows begin that hold a fingerprint of the benchmark."""
        wanted = np.zeros(n_windows, bool)
        if n_windows and len(self.prints):
            grams = shingles(words, K)
            at = winnow(grams, firsts, len(words))
            place = np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)
            at = at[self.prints[place] == grams[at]]
            for back in range(WINDOW):
                start = at - back
                wanted[start[(start >= 0) & (start < n_windows)]] = True
        return np.flatnonzero(wanted)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t) // 2 + 1  # words at most
        if size >= most:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    if ids or not size:
        yield Index(ids, texts)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("_text").nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document with its hits; ``keep`` names columns of ``docs`` to carry along, as _keep_0, _keep_1, ...."""
    context, kept = docs.sparkSession.sparkContext, Carried(docs, list(keep))
    blocks = [context.broadcast(b) for b in _blocks(benchmark, block_words)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text"), *kept.columns())
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *kept.names]
    most = 0 if len(blocks) == 1 else GATHERED_BYTES  # so that a block is read once for many documents

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(slices(batches, "_text"), most):
            found = [word_hashes(b.column("_text"), ALNUM) for b in held]
            words = np.concatenate([w for w, _ in found])
            before = np.cumsum([0, *(len(w) for w, _ in found)])
            firsts = np.concatenate([*(f[:-1] + n for (_, f), n in zip(found, before)), before[-1:]])
            hit, items = np.zeros(len(words), bool), [set() for _ in range(len(firsts) - 1)]
            for block in blocks:
                index = block.value
                more, pairs = index.hits(words, firsts)
                hit |= more
                for d, i in pairs.tolist():
                    items[d].add(index.ids[i])
                if len(blocks) > 1:
                    del index
                    vars(block).pop("_value", None)  # one block at a time in memory
            n_words, n_hit = np.diff(firsts), np.diff(np.concatenate([[0], np.cumsum(hit)])[firsts])
            sha = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items]
            own, at = [pa.array(n_words), pa.array(n_hit), pa.array([len(s) for s in items], pa.int64()), pa.array(sha), pa.array(n_hit > 0)], 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(x.slice(at, b.num_rows) for x in own), *kept.arrays(b.column("_text"), b.columns[2:])], names=names)
                at += b.num_rows

    return map_arrow(rows, mark, T.StructType([*T.StructType.fromDDL(SCHEMA).fields, *kept.fields]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns of ``docs``."""
    marked = decontaminate(docs, benchmark, keep=docs.columns)
    return marked.filter(~F.col("contaminated")).select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
