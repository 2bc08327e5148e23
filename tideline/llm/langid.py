"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its words (A-Z in lower case) and, within them, all runs of
``GRAMS`` bytes; each is hashed into ``BUCKETS`` rows of an embedding table.  The mean of
a text's rows goes through a linear layer and a softmax.  Both are trained in numpy by
stochastic gradient descent on at most ``MOST_TRAINING`` documents, those of the least
hashes; a fifth of these only calibrates.  It sets the temperature, with which the score
is the probability that a prediction is right, and the score below which predictions are
rejected: below it wrong ones are likelier than right ones, by that probability (one
half) or by the calibration rows, where wrong ones outnumber right ones by far.  For scoring, the
product of table and layer is folded into one table of logits, so each subword costs one
lookup and each text one mean; a long text is taken in pieces, between words.

A text that is null or has no letter is ``und`` with score 0, and is rejected.  Without
training rows everything is ``und``.  Repeated documents each get their row.  Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, Carried, cut_long, find_words, hash_spans, map_arrow, mix, remainder, slices, text_bytes

ALPHABET = np.zeros(256, bool)  # bytes of words: a-z and all that is not ASCII
ALPHABET[97:123] = ALPHABET[128:] = True

BUCKETS, WIDTH, GRAMS = 1 << 14, 16, (2, 3)
MOST_TRAINING, EPOCHS, BATCH, RATE = 4_000, 12, 64, 0.5
EVEN = 0.5  # a calibrated score below it is likelier wrong than right
UNKNOWN = "und"


def _after_word(data: np.ndarray) -> np.ndarray:
    """Where no word goes on: after a byte that is not a word's."""
    out = np.zeros(len(data), bool)
    out[1:] = ~ALPHABET[_LOWER[data[:-1]]] & ((data[1:] & 0xC0) != 0x80)
    return out


def subwords(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and the text of each."""
    data, offsets = text_bytes(array)
    data = _LOWER[data]
    starts, ends, firsts = find_words(data, offsets, ALPHABET)
    n_docs = len(array)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ALPHABET[data]
    doc_of_byte = np.repeat(np.arange(n_docs), np.diff(offsets))
    keys, docs = [hash_spans(data, starts, ends)], [np.repeat(np.arange(n_docs), np.diff(firsts))]
    for g in GRAMS:
        n = len(data) - g + 1
        if n <= 0:
            continue
        ok, value = np.ones(n, bool), np.full(n, g, np.uint64)
        for j in range(g):
            ok &= inside[j : j + n]
            value = value * np.uint64(257) + data[j : j + n]
        ok &= doc_of_byte[:n] == doc_of_byte[g - 1 :]
        keys.append(mix(value[ok]))
        docs.append(doc_of_byte[:n][ok])
    doc, key = np.concatenate(docs), (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return key, doc


class Model:
    """Logits of each bucket, the languages, the temperature and the score below which predictions are rejected."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.langs, self.logits, self.bias, self.temperature, self.floor = langs, logits, bias, temperature, floor

    def sums(self, keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """The logits of each text's subwords, added up."""
        return np.stack([np.bincount(doc, weights=column[keys], minlength=n_docs) for column in np.ascontiguousarray(self.logits.T)], 1)

    def predict(self, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the likeliest language of each text, and its probability, from its sums and the number of its subwords."""
        p = _softmax((total / np.maximum(count, 1)[:, None] + self.bias) * self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model | None:
    """``rows``: a text's buckets, their shares, and its language."""
    langs = sorted({lang for _, _, lang in rows})
    if not langs:
        return None
    random = np.random.Generator(np.random.PCG64(7))
    table = random.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = random.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    held = [i for i in range(len(rows)) if i % 5 == 4] if len(rows) >= 20 else []
    fit = sorted(set(range(len(rows))) - set(held))
    target = np.array([langs.index(lang) for _, _, lang in rows])
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(fit)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = [len(rows[i][0]) for i in batch]
            key, weight = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(table[key] * weight[:, None], edges, axis=0)
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(batch)), target[batch]] -= 1
            back = p @ layer.T
            layer -= rate * mean.T @ p
            bias -= rate * p.mean(0)
            np.subtract.at(table, key, rate * np.repeat(back, sizes, axis=0) * weight[:, None])
    model = Model(langs, table @ layer, bias)
    check = held or fit
    keys, weights = np.concatenate([rows[i][0] for i in check]), np.concatenate([rows[i][1] for i in check])
    doc = np.repeat(np.arange(len(check)), [len(rows[i][0]) for i in check])
    z = np.stack([np.bincount(doc, weights=model.logits[keys, k] * weights, minlength=len(check)) for k in range(len(langs))], 1) + bias
    right = target[check]
    loss = {t: -np.log(np.maximum(_softmax(z * t)[np.arange(len(check)), right], 1e-12)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)}
    model.temperature = min(loss, key=loss.get)
    p = _softmax(z * model.temperature)
    model.floor = max(rejection(p.max(1), p.argmax(1) == right), EVEN)
    return model


def rejection(scores: np.ndarray, right: np.ndarray) -> float:
    """The score below which wrong predictions outnumber right ones by most, and by more than chance (three standard deviations); 0 if they nowhere do."""
    order = np.lexsort((~right, scores))
    excess = np.cumsum(np.where(right[order], -1, 1))
    ends = np.append(scores[order][1:] != scores[order][:-1], True)  # equal scores share their fate
    excess = np.where(ends & (excess >= 3 * np.sqrt(np.arange(1, len(excess) + 1))), excess, 0)
    k = int(excess.argmax()) if len(excess) else 0
    return float(np.nextafter(scores[order][k], 2)) if len(excess) and excess[k] > 0 else 0.0


def fit(docs: DataFrame, most_training: int = MOST_TRAINING) -> Model | None:
    """A model from those documents with a language whose crc32(doc_id) mod 4 is not 2, of the least hashes."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    keyed = rows.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long"))
    bound = keyed.orderBy("h", "doc_id").limit(most_training).agg(F.max("h")).first()[0]
    if bound is None:
        return None
    sample = rows.filter(F.xxhash64(F.col("doc_id").cast("long")) <= bound).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, doc = subwords(batch.column("text"))
            keys, counts = keys[np.argsort(doc, kind="stable")], np.bincount(doc, minlength=batch.num_rows)
            ends = np.cumsum(counts)
            found, times = [], []
            for a, b in zip(ends - counts, ends):
                k, n = np.unique(keys[a:b], return_counts=True)
                found.append(k.astype(np.int16))
                times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.int16())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "lang", "k", "n"])

    got = map_arrow(sample, count, "doc_id long, lang string, k array<smallint>, n array<int>").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(most_training).toArrow()
    keys, times = (got.column(c).combine_chunks() for c in ("k", "n"))
    ends, k, n = keys.offsets.to_numpy(), keys.values.to_numpy(), times.values.to_numpy()
    rows = [(k[a:b], n[a:b] / n[a:b].sum(), lang) for a, b, lang in zip(ends[:-1], ends[1:], got.column("lang").to_pylist()) if b > a]
    return train(rows)


def identify(docs: DataFrame, model: Model | None, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; ``keep`` names columns to carry along, as _keep_0, _keep_1, ...."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), Carried(docs, list(keep))
    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("_text"), *kept.columns())
    names = ["doc_id", "held_out", "lang_pred", "score", "rejected", *kept.names]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            pieces, firsts = cut_long(texts, _after_word)
            total, counts = np.zeros((batch.num_rows, len(m.langs) if m else 0)), np.zeros(batch.num_rows, np.int64)
            for at in [0] if pieces is texts else range(len(pieces)):  # a slice at once; a long text in pieces
                keys, doc = subwords(texts if pieces is texts else pieces.slice(at, 1))
                doc = doc if pieces is texts else doc + (np.searchsorted(firsts, at, side="right") - 1)
                counts += np.bincount(doc, minlength=batch.num_rows)
                total += m.sums(keys, doc, batch.num_rows) if m else 0
            data, offsets = text_bytes(texts)
            plain = np.concatenate([[0], np.cumsum(((_LOWER[data] >= 97) & (_LOWER[data] <= 122)))])
            letters = np.diff(plain[offsets]) > 0
            for i in np.flatnonzero(~letters & (counts > 0)):
                letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
            if m is None:
                lang, score, floor = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), 0.0
            else:
                best, score = m.predict(total, counts)
                lang, floor = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)], m.floor
            score = np.where(letters, np.clip(score, 0, 1), 0.0)
            rejected = ~letters | (score < floor) | (m is None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), *kept.arrays(texts, batch.columns[3:])], names=names)

    schema = T.StructType([*T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double, rejected boolean").fields, *kept.fields])
    return map_arrow(rows, predict, schema)


def drop_rejected(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose language is not rejected, with the columns of ``docs``."""
    named = identify(docs, model, keep=docs.columns)
    return named.filter(~F.col("rejected")).select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
