"""Token-ID output: Parquet list columns in the order of ``doc_id``.

Format.  One row per document: ``doc_id``, ``n_tokens``, ``part``, ``part_start`` and
``tokens``, a list of 32-bit ids that ends with the end id.  Rows ascend in ``doc_id``
across files (part-00000 first) and within each.  Ids are plain pages of format 2, so
they are delta-encoded; the small columns are dictionary- or delta-encoded.  Row groups
and pages are small enough for readers to skip by page index, so ``n_tokens`` alone, or
a range of ``doc_id``, is read without touching other ids.  ``part_start`` is the number
of ids before the document in its file's part; adding the parts before gives its place
in the whole stream.

Ids are those of the tokenizers library.  Its pre-tokenizer splits a text into pieces
that are encoded one by one, so each task finds the pieces with numpy, encodes distinct
pieces once with the library's model (as long as it remembers them, which is bounded),
and gathers ids by piece; a text that holds an added token's string goes through the
library as a whole.  Pieces are told apart by a 64-bit hash.  A long text is encoded in
parts that begin with a blank between words, so that memory doesn't follow its length.

Null and empty texts give just the end id.  A null ``doc_id`` comes first, and rows that
tie in ``doc_id`` are ordered by the beginnings of their texts, then by a hash; ranges
may cut such ties, so that only rows that repeat as a whole share a task.
An empty table gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, Scratch, _powers, cut_long, map_arrow, mix, ragged, slices, small_table, text_bytes

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.enable.dictionary#tokens.list.element": "false",
    "compression": "zstd",
}
SCHEMA = "doc_id long, n_tokens long, part int, part_start long, tokens array<int>"
MOST_PIECES, MOST_IDS = 1 << 19, 1 << 21  # distinct pieces that a task remembers, and about their ids: some 16 MB

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASSES:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for lo, hi in ((0, 0x323B0), (0xE0000, 0xE0200)):  # no letters, digits or blanks elsewhere
            kinds[lo:hi] = [{"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER) for c in map(chr, range(lo, hi))]
        blanks = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # Unicode's White_Space
        kinds[blanks] = SPACE
        _CLASSES.append(kinds)
    return _CLASSES[0]


_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: what may follow an apostrophe


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts, which begin at ``firsts``.

    A piece is a run of letters, of digits or of others, with one blank U+0020 before
    it if there is one; or a contraction; or blanks, of which the last, if something
    follows, goes with what follows or stands alone.
    """
    n = len(points)
    kinds = _classes()[points]
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    head = np.zeros(n + 1, bool)  # the first of its text
    head[firsts] = True
    head = head[:n]
    start |= head
    # the last blank of a run that something follows is cut off, and a plain one joins what follows
    follows = np.zeros(n, bool)
    follows[:-1] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~head[1:]
    at = np.flatnonzero(follows)
    start[at] = True
    start[at[points[at] == 32] + 1] = False
    # contractions
    p = np.flatnonzero((points == 39) & start)
    p = p[p + 1 < n]
    p = p[(kinds[p + 1] == LETTER) & ~head[p + 1]]
    if len(p):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        heads = np.concatenate([head, np.ones(3, bool)])
        for ending in _CONTRACTIONS:
            hit = np.ones(len(p), bool)
            for j, c in enumerate(ending):
                hit &= (padded[p + 1 + j] == ord(c)) & ~heads[p + 1 + j]
            q, p = p[hit], p[~hit]
            start[q + 1] = False
            after = q + 1 + len(ending)
            start[after[after < n]] = True
    return np.flatnonzero(start)


_ALNUM_ASCII = np.zeros(256, bool)
_ALNUM_ASCII[48:58] = _ALNUM_ASCII[65:91] = _ALNUM_ASCII[97:123] = True


def _before_word(data: np.ndarray) -> np.ndarray:
    """Where a blank stands between letters or digits: a piece always begins there."""
    out = np.zeros(len(data), bool)
    out[1:-1] = (data[1:-1] == 32) & _ALNUM_ASCII[data[:-2]] & _ALNUM_ASCII[data[2:]]
    return out


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; remembers the ids of distinct pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = np.zeros(256, "<u4")  # the letter that stands for each byte of valid UTF-8
        for c in (*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000)):
            for byte, letter in zip(chr(c).encode(), letters.pre_tokenize_str(chr(c))[0][0]):
                self.letters[byte] = ord(letter)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.lengths, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, place: np.ndarray, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Puts new pieces, given by their bytes, before the places given in the ascending hashes."""
        mapped = self.letters[data[ragged(starts, sizes)]].tobytes().decode("utf-32-le")
        tokenize, ids, ends, a = self.model.tokenize, [], [], 0
        for b in np.cumsum(sizes).tolist():
            ids += [t.id for t in tokenize(mapped[a:b])]
            ends.append(len(ids))
            a = b
        ends = np.array(ends, np.int64)
        lengths = np.diff(ends, prepend=0)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = (self.used + ends - lengths).astype(np.int32)
        self.used += len(ids)
        self.hashes, self.lengths, self.at = np.insert(self.hashes, place, hashes), np.insert(self.lengths, place, lengths.astype(np.int32)), np.insert(self.at, place, at)

    def _look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        return place, ~known

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; long texts are encoded in pieces, as their ids are those of their pieces'."""
        pieces, firsts = cut_long(array, _before_word)
        if pieces is array or any(a.encode() in text_bytes(array)[0].tobytes() for a in self.added):
            return self._encode(array)
        got = [self._encode(pieces.slice(i, 1)) for i in range(len(pieces))]
        counts = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in got])])
        return np.concatenate([ids for ids, _ in got]), np.diff(counts[firsts])

    def _encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(array)
        raw = data.tobytes()
        if any(a.encode() in raw for a in self.added):
            each = [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.int32) for t in array.to_pylist()]
            return np.concatenate([*each, np.zeros(0, np.int32)]), np.array([len(e) for e in each], np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(array), np.int64)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        bytes_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each code point begins
        firsts = np.searchsorted(bytes_at, offsets)
        starts = piece_starts(points, firsts[:-1][firsts[:-1] < len(points)])
        ends = np.append(starts[1:], len(points))
        up, down = _powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(_ODD)) * up[: len(points)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place, new = self._look_up(distinct)
        if len(self.hashes) + int(new.sum()) > MOST_PIECES or self.used > MOST_IDS:
            self.forget()
            place, new = self._look_up(distinct)
        if new.any():
            first = bytes_at[starts[example[new]]]
            self._learn(place[new], distinct[new], data, first, bytes_at[ends[example[new]]] - first)
        index = np.searchsorted(self.hashes, distinct)[inverse]
        lengths = self.lengths[index].astype(np.int64)
        ids = self.ids[ragged(self.at[index], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(starts, firsts)])


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 0, name: str = "tokens") -> DataFrame:
    """Encodes ``docs`` (doc_id, text), writes the files under ``scratch`` and returns them as read back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, counts = coder.encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts + 1)])
            out = np.full(offsets[-1], end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[offsets[1:] - 1] = False
            out[keep] = ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts + 1), pa.array(np.full(len(counts), part, np.int32)), pa.array(offsets[:-1] + before), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))],
                names=["doc_id", "n_tokens", "part", "part_start", "tokens"],
            )
            before += int(offsets[-1])

    text = F.col("text").cast("string")
    order = ["doc_id", "head", "hash"]
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.left(text, F.lit(64)).alias("head"), F.xxhash64(text).alias("hash"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.keep(map_arrow(ordered, encode, SCHEMA), name, **WRITER)


def stream_starts(tokens: DataFrame) -> DataFrame:
    """The files' rows with ``start``: the number of ids of all documents before.

    Reads only the small columns for the totals; one row per part goes to the driver.
    """
    rows = sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, before = [], 0
    for row in rows:
        bases.append((row.part, before))
        before += row.n
    base = small_table(tokens.sparkSession, pa.schema([("part", pa.int32()), ("_base", pa.int64())]), bases)
    return tokens.join(F.broadcast(base), "part").withColumn("start", F.col("part_start") + F.col("_base"))


def metadata(tokens: DataFrame) -> DataFrame:
    """doc_id and n_tokens alone; the ids' column chunks are not read."""
    return tokens.select("doc_id", "n_tokens")


def select_documents(tokens: DataFrame, first: int, last: int) -> DataFrame:
    """doc_id and tokens of a range of doc_id; row groups and pages outside are skipped by their statistics."""
    return tokens.filter(F.col("doc_id").between(first, last)).select("doc_id", "tokens")


def crc_of_ids(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of each row's ids as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            o = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(tokens.select("doc_id", "start", "n_tokens", "tokens"), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
