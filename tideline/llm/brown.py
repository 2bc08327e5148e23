"""LM scoring with a Brown class-based bigram model.

Tokens are the words of a text, A-Z in lower case, and an end.  Every word of the training
texts has a class:

* the ``TOP`` most frequent words by exchange clustering on their bigram counts: each word in
  turn moves to the class that gives the training text the greatest likelihood, until a
  pass moves none (the likelihood only rises, so that comes; ``PASSES`` bounds it);
* every further word by its own neighbours: all its occurrences count towards the class
  that makes them likeliest.  Words of the head (the ``HEAD`` most frequent) are judged by
  neighbours among the top words, all others by neighbours in the head.

A token's probability is P(class | class before) * P(word | class), the first interpolated
with the classes' own frequencies, the second with one added to each count.  One word is
kept for those never seen, in the class with most words seen once.  As a word before,
one beyond the head has a class of its own kind (``RARE``).  It sums to 1.

All counts cover all training texts and grow with them.  Texts are hashed twice: to count
words, and to store each text as numbers of head words with the hashes of others; all
later passes read these.  The head goes to the executors (a fixed bound); words beyond it
meet their counts and classes in joins.  At most (``TOP`` + 2)^2 bigram counts go to the
driver, in ``PORTIONS`` portions.  Words are told apart by a 64-bit hash.

Null and empty texts have just the end.  Without training rows every count is 0.
Repeated documents each get their row; a null doc_id is in training.  An empty table
gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, Scratch, map_arrow, remainder, signed, slices, small_table, word_hashes

HEAD, TOP, CLASSES = 1 << 18, 4_096, 48
PASSES, ALPHA = 50, 5.0
END, RARE = CLASSES - 1, CLASSES  # classes of the end, and of words before that are beyond the head
SIDES = CLASSES + 1  # classes that a neighbour can have
END_HASH = np.uint64(1)
MOST_HELD = 1 << 18  # distinct keys that a task holds before it passes counts on
PORTIONS, PORTION = 8, 1 << 20
ROWS = 1 << 14  # rows that are scored against all classes at once


# ------------------------------------------------------------------ counting


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(arrays: Iterator[np.ndarray], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with counts; a key may come again once ``most`` distinct ones were held."""
    most = most or MOST_HELD
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for keys in arrays:
        held.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in held) > most:
            held = [summed(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > most // 2:
                yield held.pop()
    if held:
        yield summed(*(np.concatenate(x) for x in zip(*held)))


def count_tokens(train: DataFrame) -> DataFrame:
    """h and count of every distinct token; the end has END_HASH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = 0

        def hashes() -> Iterator[np.ndarray]:
            nonlocal docs
            for batch in slices(batches, "text"):
                docs += batch.num_rows
                yield word_hashes(batch.column("text"), SOLID)[0]

        for h, c in counted(hashes()):
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c.astype(np.int64))], names=["h", "c"])
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array([END_HASH]))), pa.array([docs])], names=["h", "c"])

    return map_arrow(train.select(F.col("text").cast("string")), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# ------------------------------------------------------------------ texts as numbers


class Head:
    """The head words by hash, and the number of each: 0 is the most frequent."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.lexsort((h, -c))
        self.counts = c[order]
        by_hash = np.argsort(h[order])
        self.h, self.number = h[order][by_hash], by_hash.astype(np.int32)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 beyond the head."""
        if not len(self.h):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.number[at], -1).astype(np.int32)


def _cells(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary cells: the bytes of values[edges[i]:edges[i+1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _values(cells: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary cells, and where each cell's begin (and the last ends)."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = cells.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def encode(rows: DataFrame, head) -> DataFrame:
    """row, doc_id, held_out, ``ids`` (32-bit numbers of words, -1 beyond the head) and ``far`` (64-bit hashes of these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            h, firsts = word_hashes(batch.column("text"), SOLID)
            ids = head.value.look_up(h)
            far = np.flatnonzero(ids < 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + np.arange(batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), _cells(ids, firsts), _cells(h[far], np.searchsorted(far, firsts))], names=["row", "doc_id", "held_out", "ids", "far"]
            )
            at += batch.num_rows

    return map_arrow(rows, run, "row long, doc_id long, held_out boolean, ids binary, far binary")


def with_ends(values: np.ndarray, firsts: np.ndarray, end: float) -> np.ndarray:
    """The values with one ``end`` after each text."""
    ends = firsts[1:] + np.arange(len(firsts) - 1)
    out = np.full(len(values) + len(ends), end, values.dtype)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = values
    return out


def before(values: np.ndarray, end: int) -> np.ndarray:
    """The value before each; before a text's first is the end, which is also the value after the last text."""
    return np.concatenate([np.full(min(len(values), 1), end, values.dtype), values[:-1]])


def after(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values[1:], values[-1:]])


# ------------------------------------------------------------------ classes of the top words


def count_pairs(encoded: DataFrame, top: int) -> DataFrame:
    """pair (unit before * (top + 2) + unit) and its count; beyond the top words there is one unit, and one is the end."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids, firsts = _values(batch.column("ids"), np.int32)
            units = with_ends(np.where((ids < 0) | (ids >= top), top, ids).astype(np.int32), firsts, top + 1)
            yield before(units, top + 1) * np.int32(top + 2) + units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in counted(keys(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], names=["pair", "c"])

    return map_arrow(encoded.select("ids"), run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def cluster(u: np.ndarray, v: np.ndarray, c: np.ndarray, words: int, classes: int = CLASSES, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit by exchange, and the counts of classes; ``c`` counts unit ``v`` after unit ``u``, and ``u`` ascends.

    Units 0 .. words - 1 are words and go to classes 0 .. classes - 2.  The unit after them, all other words, keeps
    class ``classes``, and the last, the end, class ``classes - 1``.
    """
    units, all_classes = words + 2, classes + 1
    own_counts, before_, after_, table = np.zeros(units), np.zeros(units), np.zeros(units), np.zeros(all_classes**2)
    for at in range(0, len(c), PORTION):
        x, y, n = u[at : at + PORTION], v[at : at + PORTION], c[at : at + PORTION]
        after_ += np.bincount(x, n, units)
        before_ += np.bincount(y, n, units)
        own_counts[x[x == y]] = n[x == y]
    size = before_ + after_
    order = np.argsort(-size[:words], kind="stable")
    cls = np.empty(units, np.int64)
    cls[order] = np.arange(words) % (classes - 1)
    cls[words], cls[words + 1] = classes, classes - 1
    for at in range(0, len(c), PORTION):
        table += np.bincount(cls[u[at : at + PORTION]] * all_classes + cls[v[at : at + PORTION]], c[at : at + PORTION], all_classes**2)
    table = table.reshape(all_classes, all_classes)
    right_edges, left_edges = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=units))]) for x in (u, v))
    to_left = np.argsort(v, kind="stable").astype(np.int32)
    for _ in range(passes):
        moved = 0
        for w in order[size[order] > 0]:
            a, own = cls[w], own_counts[w]
            i, j = right_edges[w], right_edges[w + 1]
            right = np.bincount(cls[v[i:j]], c[i:j], all_classes)
            some = to_left[left_edges[w] : left_edges[w + 1]]
            left = np.bincount(cls[u[some]], c[some], all_classes)
            right[a] -= own
            left[a] -= own
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            logs = _xlogx(table)
            rows = _xlogx(table + right[None, :]) - logs
            cols = _xlogx(table + left[:, None]) - logs
            corner = np.diag(table)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + _xlogx(corner + right + left + own) - np.diag(logs)
            for sums, more in ((table.sum(1), right.sum() + own), (table.sum(0), left.sum() + own)):
                gain -= _xlogx(sums + more) - _xlogx(sums)
            gain[classes - 1 :] = -np.inf
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-6 else a
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            cls[w] = b
            moved += b != a
        if not moved:
            break
    return cls, table


# ------------------------------------------------------------------ classes of all further words


def fit_to_neighbours(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an occurrence after a class, and before a class, speaks for each class of words: log(P(neighbour, class) / (P(neighbour) P(class)))."""
    own = (table.sum(0) + 1) / (table.sum() + len(table))
    p = np.log((table + ALPHA * own[None, :]) / (table.sum(1, keepdims=True) + ALPHA) / own[None, :])
    left, right = np.ascontiguousarray(p[:, :END]), np.ascontiguousarray(p[:END].T)
    empty = (table.sum(0) + table.sum(1) == 0)[:END]
    if not empty.all():
        left[:, empty] = right[:, empty] = -1e3
    return left, right


def neighbours(encoded: DataFrame, classes, top: int) -> DataFrame:
    """word, left, right and n for head words beyond the top: how often each stands between which classes."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids, firsts = _values(batch.column("ids"), np.int32)
            of = classes.value
            cls = with_ends(np.where((ids >= 0) & (ids < top), of[np.clip(ids, 0, top)], RARE).astype(np.int32), firsts, END)
            ids = with_ends(ids, firsts, -1)
            some = ids >= top
            yield (ids[some] * np.int32(SIDES) + before(cls, END)[some]) * np.int32(SIDES) + after(cls)[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in counted(keys(batches)):
            yield pa.RecordBatch.from_arrays([pa.array((k // SIDES**2).astype(np.int64)), pa.array((k // SIDES % SIDES).astype(np.int8)), pa.array((k % SIDES).astype(np.int8)), pa.array(n.astype(np.int32))], names=["word", "left", "right", "n"])

    return map_arrow(encoded.select("ids"), run, "word long, left byte, right byte, n int")


def far_neighbours(encoded: DataFrame, classes) -> DataFrame:
    """word (its hash), left, right and n (1) for each occurrence of a word beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts = _values(batch.column("ids"), np.int32)
            far = _values(batch.column("far"), np.int64)[0]
            cls = with_ends(classes.value[ids].astype(np.int8), firsts, END)  # at -1 stands RARE
            some = np.flatnonzero(with_ends(ids, firsts, 0) < 0)
            yield pa.RecordBatch.from_arrays([pa.array(far), pa.array(before(cls, END)[some]), pa.array(after(cls)[some]), pa.array(np.ones(len(far), np.int32))], names=["word", "left", "right", "n"])

    return map_arrow(encoded.select("ids", "far"), run, "word long, left byte, right byte, n int")


def best_classes(rows: DataFrame, left_fit: np.ndarray, right_fit: np.ndarray) -> DataFrame:
    """Of rows (word, left, right, n), the class of each ``word``; and, with ``left`` set, how often the class stood after which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIDES * CLASSES, np.int64)
        held = [np.zeros(0, np.int64), np.zeros((0, END)), np.zeros((0, SIDES), np.int64)]  # the last word's, which may go on

        def done(words: np.ndarray, scores: np.ndarray, lefts: np.ndarray) -> pa.RecordBatch:
            cls = scores.argmax(1)
            np.add.at(table.reshape(SIDES, CLASSES).T, cls, lefts)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.nulls(len(words), pa.int8()), pa.array(cls.astype(np.int8)), pa.nulls(len(words), pa.int64())], names=["word", "left", "cls", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                word, left, right, n = (batch.column(c).slice(at, ROWS).to_numpy(zero_copy_only=False) for c in ("word", "left", "right", "n"))
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                scores = np.add.reduceat((left_fit[left] + right_fit[right]) * n[:, None], first, axis=0)
                which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
                lefts = np.bincount(which * SIDES + left, n, len(first) * SIDES).astype(np.int64).reshape(-1, SIDES)
                words = word[first]
                if len(held[0]) and held[0][0] == words[0]:
                    scores[0] += held[1][0]
                    lefts[0] += held[2][0]
                elif len(held[0]):
                    yield done(*held)
                yield done(words[:-1], scores[:-1], lefts[:-1])
                held = [words[-1:], scores[-1:], lefts[-1:]]
        if len(held[0]):
            yield done(*held)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array((at // CLASSES).astype(np.int8)), pa.array((at % CLASSES).astype(np.int8)), pa.array(table[at])], names=["word", "left", "cls", "n"])

    return map_arrow(rows.repartition("word").sortWithinPartitions("word"), run, "word long, left byte, cls byte, n long")


def count_steps(encoded: DataFrame, classes) -> DataFrame:
    """left, cls and n: how often a head word or end of a class, or a word beyond the head, stands after a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIDES * SIDES, np.int64)
        for batch in batches:
            ids, firsts = _values(batch.column("ids"), np.int32)
            cls = with_ends(classes.value[ids].astype(np.int32), firsts, END)
            table += np.bincount(before(cls, END) * SIDES + cls, minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array((at // SIDES).astype(np.int8)), pa.array((at % SIDES).astype(np.int8)), pa.array(table[at])], names=["left", "cls", "n"])

    return map_arrow(encoded.select("ids"), run, "left byte, cls byte, n long")


# ------------------------------------------------------------------ the model


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


class Model:
    """Log10 probabilities: ``step`` of a class after a class, ``norm`` of a word's class, for a word of count n: step + log10(n + 1) - norm."""

    def __init__(self, table: np.ndarray, tokens: np.ndarray, words: np.ndarray, once: np.ndarray):
        self.unseen = int(once[:END].argmax())
        inside = words.astype(np.float64)
        inside[self.unseen] += 1
        inside[END] = 1
        own = np.where(inside > 0, tokens + 1.0, 0.0)
        own /= own.sum()
        p = (table + ALPHA * own[None, :]) / (table.sum(1, keepdims=True) + ALPHA)
        self.step = np.log10(np.maximum(p, 1e-300))
        self.norm = np.log10(np.maximum(tokens + inside, 1.0))


def learn_head(counts: DataFrame) -> tuple[Head, int]:
    """The most frequent words, as many as have counts that all fit into HEAD, and the least count of these."""
    words = counts.filter(F.col("h") != int(END_HASH))
    spread = words.groupBy("c").agg(F.count("*").alias("words")).toArrow().sort_by([("c", "descending")])
    fits = np.cumsum(_numbers(spread, "words")) <= HEAD
    least = int(_numbers(spread, "c")[fits].min()) if fits.any() else 1 << 62
    head = words.filter(F.col("c") >= least).toArrow()
    return Head(_numbers(head, "h").view(np.uint64), _numbers(head, "c")), least


def learn(encoded: DataFrame, counts: DataFrame, head: Head, least: int, scratch: Scratch) -> tuple[Model, np.ndarray, DataFrame]:
    """The model, the classes of head words (RARE at the end), and word, c and cls of the words beyond."""
    context = encoded.sparkSession.sparkContext
    top = min(TOP, len(head.counts))
    pairs = scratch.keep(count_pairs(encoded, top), "pairs")
    parts = [pairs.filter(F.pmod("pair", F.lit(PORTIONS)) == i).toArrow() for i in range(PORTIONS)]
    key, c = np.concatenate([p.column("pair").to_numpy() for p in parts]), np.concatenate([p.column("c").to_numpy() for p in parts])
    del parts
    order = np.argsort(key, kind="stable").astype(np.int32)
    key, c = key[order], c[order]
    cls, table = cluster((key // (top + 2)).astype(np.uint16), (key % (top + 2)).astype(np.uint16), c, top)
    del key, c, order
    classes = np.full(len(head.counts) + 1, RARE, np.int8)
    classes[:top] = cls[:top]
    if len(head.counts) > top:
        shared = context.broadcast(np.append(cls[:top], RARE))
        found = scratch.keep(best_classes(neighbours(encoded, shared, top), *fit_to_neighbours(table)), "head-classes")
        got = found.filter("word is not null").select("word", "cls").toArrow()
        classes[_numbers(got, "word")] = _numbers(got, "cls")
        shared.destroy()
    shared = context.broadcast(classes)
    steps = count_steps(encoded, shared).groupBy("left", "cls").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((SIDES, SIDES))
    table[_numbers(steps, "left"), _numbers(steps, "cls")] = _numbers(steps, "n")
    fit = fit_to_neighbours(table)
    table = table[:, :CLASSES]  # words beyond the head come in by their own classes
    far = scratch.keep(best_classes(far_neighbours(encoded, shared), *fit), "far-classes")
    more = far.filter("left is not null").groupBy("left", "cls").agg(F.sum("n").alias("n")).toArrow()
    table[_numbers(more, "left"), _numbers(more, "cls")] += _numbers(more, "n")
    words = counts.filter((F.col("c") < least) & (F.col("h") != int(END_HASH))).withColumnRenamed("h", "word")
    words = scratch.keep(words.join(far.filter("word is not null").select("word", "cls"), "word"), "far-words")
    of_class = words.groupBy("cls").agg(F.count("*").alias("words"), F.count_if(F.col("c") == 1).alias("once")).toArrow()
    inside, once = np.bincount(classes[:-1], minlength=SIDES)[:CLASSES], np.bincount(classes[:-1][head.counts == 1], minlength=SIDES)[:CLASSES]
    inside[_numbers(of_class, "cls")] += _numbers(of_class, "words")
    once[_numbers(of_class, "cls")] += _numbers(of_class, "once")
    shared.destroy()
    scratch.drop("pairs", "head-classes", "far-classes")
    return Model(table, table.sum(0), inside, once), classes, words


def score(docs: DataFrame, scratch: Scratch, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", modulus) == held_out).alias("held_out"), F.col("text").cast("string"))
    counts = scratch.keep(count_tokens(rows.filter(~F.col("held_out"))), "counts")
    head, least = learn_head(counts)
    words = spark.sparkContext.broadcast(head)
    encoded = scratch.keep(encode(rows, words), "encoded", compression="zstd")
    words.destroy()
    model, classes, far_words = learn(encoded.filter("not held_out"), counts, head, least, scratch)
    totals = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("h") == int(END_HASH), F.col("c")))).first()
    n, n_end = totals[0] or 0, totals[2] or 0
    base = np.log10(n + totals[1] + 1)
    shared = spark.sparkContext.broadcast((model, classes, head.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, of, head_counts = shared.value
        head_counts = np.append(head_counts, 0)
        for batch in batches:
            ids, firsts = _values(batch.column("ids"), np.int32)
            n_docs, far = batch.num_rows, _values(batch.column("far"), np.int64)[0]
            doc = np.repeat(np.arange(n_docs), np.diff(firsts) + 1)
            last = before(with_ends(of[ids], firsts, END), END)
            cls = with_ends(np.where(ids < 0, m.unseen, of[ids]), firsts, END)  # a word beyond the head counts as unseen here
            seen = with_ends(head_counts[ids], firsts, n_end)
            logs = np.log10(seen + 1.0)
            per = lambda v, doc=doc, n_docs=n_docs: np.bincount(doc, weights=v, minlength=n_docs)
            # the end is one word, with all its class's tokens
            token = m.step[last, cls] + logs - m.norm[cls]
            some = np.flatnonzero(with_ends(ids, firsts, 0) < 0)
            far_doc, far_last = doc[some], last[some]
            order = np.lexsort((far_last, far, far_doc))
            w, d, p = far[order], far_doc[order], far_last[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(w))).astype(np.int32)
            offsets = pa.array(np.searchsorted(d[starts], np.arange(n_docs + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w[starts], p[starts].astype(np.int8), times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "held_out")), pa.array(np.diff(firsts) + 1), pa.array(per(seen > 0).astype(np.int64)), pa.array(per(logs - base)), pa.array(per(token)), *lists],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "lefts", "times"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, lefts array<byte>, times array<int>"
    parts = scratch.keep(map_arrow(encoded, run, schema), "parts")
    scratch.drop("encoded")
    pairs = parts.select("row", F.explode(F.arrays_zip("words", "lefts", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.lefts").alias("left"), F.col("w.times").alias("times"))
    # what a word's own class and count add to those of an unseen word
    change = [(h, c, float(model.step[h, c] - model.norm[c] - model.step[h, model.unseen] + model.norm[model.unseen])) for h in range(SIDES) for c in range(END)]
    change = small_table(spark, pa.schema([("left", pa.int8()), ("cls", pa.int8()), ("change", pa.float64())]), change)  # SIDES * END rows
    joined = pairs.join(far_words, "word").join(F.broadcast(change), ["left", "cls"])
    log = F.log10(F.col("c") + F.lit(1.0))
    found = joined.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.col("times") * (log + F.col("change"))).alias("gain"), F.sum("times").alias("n"))
    out = parts.drop("words", "lefts", "times").join(found, "row", "left")
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
