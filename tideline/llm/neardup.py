"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

A document is its shingles of ``WORDS`` words (all its words, if it has fewer), each with
its number of occurrences as its weight; with ``weights="set"`` each weighs 1.  Darts: each
element owns a plane of weight by rank, in which points are thrown by hashing: a cell of
the plane holds a Poisson number of darts, drawn from the cell's hash, each with a weight,
a rank and one of ``K`` coordinates.  A document owns the darts of its elements that lie
below their weights; per coordinate the dart of least rank is kept.  Cells are visited in
doubling layers of rank until all coordinates are filled, so the work follows the number
of elements plus K log K.  Two documents agree in a coordinate with a probability equal to
their (weighted) Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates make buckets; at similarity 0.8 a pair shares no
bucket with a probability of (1 - 0.8^6)^40 = 5e-6.  Within a bucket not all pairs are
formed.  First every member is compared with one pivot, and links are contracted to
classes, which closes nearly all buckets.  In a bucket that still holds several classes,
members outside its largest class are compared with all members of other classes, in
blocks of bounded size, of which only new links come out.  No pair that shares a bucket is
left out but those already in one class.  All comparisons are exact, on the 32-bit hashes
of the elements.

Documents with the same words are one node from the start, by a 64-bit hash, so groups of
copies don't meet in a bucket.  Everything between steps is a table in the shared folder.

Null, empty and wordless texts are each their own class.  Rows that repeat are copies.
``class_id`` is the least doc_id of the class; a null doc_id is ignored there.  An empty
table gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, HashFilter, Scratch, column, map_arrow, mix, shingles, signed, slices, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
K = BANDS * ROWS
LAYER = 2.0**-4  # rank that the first layer spans
BLOCK_ELEMENTS, BLOCK_ROWS = 1_000_000, 1_500  # about what a block of members holds at most
COLUMNS = 4_096  # elements that one product of matrices takes
SKETCH_BYTES = 1 << 20

_ODDS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(K)], np.uint64)


def _poisson(rate: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number, as 64-bit thresholds."""
    p, total, out, j = np.exp(-rate), 0.0, [], 0
    while total + p < 1 - 1e-16 and j < 40:
        total += p
        out.append(total)
        j += 1
        p *= rate / j
    return np.array([int(min(t, 1 - 2.0**-53) * 2**64) for t in out], np.uint64)


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, doc: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """The kept dart of each coordinate, one row for each document; ``doc`` ascends.

    ``weights`` are positive, None for 1.  An element of weight w owns layers [0, 1),
    [1, 2), ... of the weight axis, the last in part.  A row without elements is 0.
    """
    if weights is not None:
        layers = np.ceil(weights).astype(np.int64)
        m = np.arange(int(layers.sum())) - np.repeat(np.cumsum(layers) - layers, layers)
        part = np.minimum(np.repeat(weights, layers) - m, 1.0)
        part = None if (part == 1).all() else part
        elements, doc = mix(np.repeat(elements, layers) + m.astype(np.uint64) * _ODDS[1]), np.repeat(doc, layers)
    else:
        part = None
    best = np.zeros((n_docs, k), np.uint64)
    open_ = np.ones((n_docs, k), bool)
    live = np.zeros(n_docs, bool)
    live[doc] = True
    open_[~live] = False
    lo, width, cell = 0.0, LAYER, 0
    while len(elements):
        steps = max(1, int(width))  # wide layers are cut into cells of rank 1
        limits = _poisson(width / steps)
        for step in range(steps):
            salt = mix(np.array([cell * 0x2545F4914F6CDD1D % (1 << 64)], np.uint64))[0]
            cell += 1
            key = mix(elements ^ salt)
            some = np.flatnonzero(key >= limits[0])
            if not len(some):
                continue
            key = key[some]
            count = np.searchsorted(limits, key, side="right")
            owner = np.repeat(some, count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(np.repeat(key, count) + (number.astype(np.uint64) + np.uint64(1)) * _ODDS[2])
            if part is not None:
                under = (mix(dart ^ _ODDS[3]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part[owner]
                dart, owner = dart[under], owner[under]
            place = doc[owner] * k + (mix(dart ^ _ODDS[4]) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((dart, place))  # a dart's own bits are its rank within the cell
            place, dart = place[order], dart[order]
            first = np.ones(len(place), bool)
            first[1:] = place[1:] != place[:-1]
            place, dart = place[first], dart[first]
            free = open_.ravel()[place]
            best.ravel()[place[free]] = dart[free]
            open_.ravel()[place[free]] = False
        lo += width
        width = lo
        going = open_.any(1)[doc]
        if not going.all():
            elements, doc = elements[going], doc[going]
            part = part[going] if part is not None else None
    return best


def weighted(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, how often each occurs in its text, and the text."""
    n = np.diff(firsts)
    s = np.zeros(len(words), np.uint64)
    s[: max(0, len(words) - WORDS + 1)] = shingles(words, WORDS)
    keep = np.ones(len(words), bool)
    for j in range(1, WORDS):  # shingles that would run into the next text
        at = firsts[1:] - j
        keep[at[(at >= firsts[:-1]) & (n > 0)]] = False
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        a, b = firsts[i], firsts[i + 1]
        s[a], keep[a] = shingles(words[a:b], int(b - a))[0], True
    s, doc = s[keep], np.repeat(np.arange(len(n)), n)[keep]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), doc[at]


def elements(words: np.ndarray, firsts: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """What two texts are compared by, and the text of each: distinct shingles; ``counted`` gives repeats an element each."""
    s, count, doc = weighted(words, firsts)
    if not counted:
        return s, doc
    repeat = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    s, doc = np.repeat(s, count), np.repeat(doc, count)
    return np.where(repeat > 0, mix(s + repeat.astype(np.uint64) * _ODDS[5]), s), doc


def nodes(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's words in their order."""
    out = np.zeros(len(firsts) - 1, np.uint64)
    if len(words):
        place = np.arange(len(words)) - np.repeat(firsts[:-1], np.diff(firsts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place.astype(np.uint64) + _ODDS[6])))])
        out = mix(sums[firsts[1:]] - sums[firsts[:-1]] + np.diff(firsts).astype(np.uint64))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = (parts * _ODDS[1 : ROWS + 1]).sum(2, dtype=np.uint64)
    return mix(key + np.arange(BANDS, dtype=np.uint64) * _ODDS[7])


def sketch(docs: DataFrame, counted: bool) -> DataFrame:
    """doc_id, text_hash, node, bands and the total weight of elements; node is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SKETCH_BYTES):
            words, firsts = word_hashes(batch.column("text"), ALNUM)
            own, weight, doc = weighted(words, firsts)
            keys = signed(band_keys(dart_signatures(own, weight if counted else None, doc, batch.num_rows)))
            count = np.bincount(doc, weight if counted else None, batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(signed(nodes(words, firsts)), mask=count == 0), lists, pa.array(count.astype(np.int32))], names=["doc_id", "text_hash", "node", "bands", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, text_hash long, node long, bands array<long>, n int")


def _read_again(docs: DataFrame, wanted: DataFrame, counted: bool) -> DataFrame:
    """node and the 32-bit hashes of its elements, for the nodes of ``wanted``.

    A filter of bounded size goes to the executors; what passes it by chance is dropped by a join.  Beyond some 10^8
    wanted nodes it passes more and more, and at last the elements of all texts go to the join: that is slower, about
    one shuffle of the input, and as exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(HashFilter(wanted.select("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, firsts = word_hashes(batch.column("text"), ALNUM)
            node = signed(nodes(words, firsts))
            passed = shared.value.passes(node) & (np.diff(firsts) > 0)
            own, doc = elements(words, firsts, counted)
            chosen = passed[doc]
            count = np.bincount(doc[chosen], minlength=batch.num_rows)[passed]
            small = (own[chosen] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(small))
            yield pa.RecordBatch.from_arrays([pa.array(node[passed]), lists], names=["node", "own"])

    found = map_arrow(docs.select(F.col("text").cast("string")), run, "node long, own array<int>")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def connect(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and label (the least node of its component) for all nodes of ``edges`` (a, b)."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-both")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("further"))
        lower = lower.join(jump, lower.label == jump.m).select("node", "was", F.least("label", "further").alias("label"))
        new = scratch.keep(lower, f"{name}-{turn}")
        moved = new.filter("label < was").limit(1).count()
        labels = new.select("node", "label")
        scratch.drop(f"{name}-{turn - 1}")
        if not moved:
            scratch.drop(f"{name}-both")
            return labels


def new_links(minor: list, major: list, similarity: float) -> list[tuple[int, int]]:
    """Of two lists of (node, label, elements): for each node of the first, a similar node of each other label.

    Sizes of all intersections come from products of 0/1 matrices over the elements that two members share.
    """
    sizes = np.array([len(x[2]) for x in minor]), np.array([len(x[2]) for x in major])
    labels = np.array([x[1] for x in minor]), np.array([x[1] for x in major])
    found, place = np.unique(np.concatenate([x[2] for x in (*minor, *major)]), return_inverse=True)
    row = np.repeat(np.arange(len(minor) + len(major)), np.concatenate(sizes))
    here, there = np.zeros(len(found), bool), np.zeros(len(found), bool)
    here[place[row < len(minor)]] = True
    there[place[row >= len(minor)]] = True
    shared = here & there
    column = np.cumsum(shared) - 1
    row, place = row[shared[place]], column[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((len(minor), len(major)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        m = np.zeros((len(minor) + len(major), COLUMNS), np.float32)
        m[row[a:b], place[a:b] - lo] = 1
        both += m[: len(minor)] @ m[len(minor) :].T
    close = both.astype(np.float64) >= (sizes[0][:, None] + sizes[1][None, :] - both) * similarity
    close &= labels[0][:, None] != labels[1][None, :]
    i, j = np.nonzero(close)
    _, first = np.unique(np.stack([i, labels[1][j]], 1), axis=0, return_index=True) if len(i) else (None, [])
    return [(minor[x][0], major[y][0]) for x, y in zip(i[first].tolist(), j[first].tolist())] if len(i) else []


def compare_blocks(members: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """New links (a, b) in buckets of several classes; members: band, node, n, label."""
    counts = members.groupBy("band", "label").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(node))").alias("h"))
    state = counts.groupBy("band").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels"), F.sum("c").alias("size"), F.bit_xor("h").alias("h"))
    # buckets of the same members are one
    once = state.filter("labels > 1").groupBy("size", "h").agg(F.min(F.struct("band", F.col("m.label").alias("main"))).alias("b"))
    once = scratch.keep(once.select("b.band", "b.main"), "open")
    rows = scratch.keep(members.join(once, "band").select("band", "node", "n", "label", (F.col("label") == F.col("main")).alias("inner")), "open-members")
    blocks = lambda x, r: F.greatest(F.ceil(x / BLOCK_ELEMENTS), F.ceil(r / BLOCK_ROWS), F.lit(1)).cast("int")
    size = rows.groupBy("band").agg(F.sum("n").alias("n_all"), F.count("*").alias("r_all"), F.sum(F.when(~F.col("inner"), F.col("n"))).alias("n_out"), F.count_if(~F.col("inner")).alias("r_out"))
    size = scratch.keep(size.select("band", blocks(F.col("n_all"), F.col("r_all")).alias("all_blocks"), blocks(F.col("n_out"), F.col("r_out")).alias("out_blocks")), "open-sizes")
    dealt = rows.join(size, "band").withColumn("h", F.xxhash64("node"))
    own_all, own_out = F.pmod("h", "all_blocks").cast("int"), F.pmod("h", "out_blocks").cast("int")
    # a pair of blocks (i, j): members outside the largest class in i (side 0), all members in j (side 1)
    as_all = F.transform(F.sequence(F.lit(0), F.col("out_blocks") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), own_all.alias("j")))
    as_out = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda j: F.struct(F.lit(0).alias("side"), own_out.alias("i"), j.alias("j")))
    spread = dealt.select("band", "node", "label", F.explode(F.when(F.col("inner"), as_all).otherwise(F.concat(as_all, as_out))).alias("p")).select("band", "p.i", "p.j", "p.side", "node", "label")
    full = spread.join(texts.select(F.col("node").alias("t"), "own"), F.col("node") == F.col("t")).drop("t")

    def run(group: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        own = group.column("own").combine_chunks()
        if isinstance(own, pa.ChunkedArray):
            own = pa.concat_arrays(own.chunks)
        flat, offsets = own.flatten().to_numpy(zero_copy_only=False), own.offsets.to_numpy() - own.offsets[0].as_py()
        for k, (side, node, label) in enumerate(zip(*(group.column(c).to_pylist() for c in ("side", "node", "label")))):
            sides[side].append((node, label, flat[offsets[k] : offsets[k + 1]]))
        links = new_links(*sides, similarity) if sides[0] and sides[1] else []
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return full.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """doc_id, class_id, class_size and text_hash of every document."""
    counted = weights == "count"
    sketched = scratch.keep(sketch(docs, counted), "sketch")
    unique = scratch.keep(sketched.filter("node is not null").select("node", "bands", "n").dropDuplicates(["node"]), "nodes")
    exploded = unique.select("node", "n", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("pivot"), F.min_by("n", "node").alias("pn"))
    shared = scratch.keep(shared.filter("c > 1").drop("c"), "shared")
    members = scratch.keep(exploded.join(shared, "band").select("band", "node", "n", "pivot", "pn"), "members")
    texts = scratch.keep(_read_again(docs, scratch.keep(members.select("node").distinct(), "wanted"), counted), "texts")
    near_size = F.least("n", "pn") >= F.greatest("n", "pn") * F.lit(similarity)
    pairs = scratch.keep(members.filter((F.col("node") != F.col("pivot")) & near_size).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    xa, xb = texts.select(F.col("node").alias("a"), F.col("own").alias("xa")), texts.select(F.col("node").alias("b"), F.col("own").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    close = both >= (F.size("xa") + F.size("xb") - both) * F.lit(similarity)
    edges = scratch.keep(pairs.join(xa, "a").join(xb, "b").filter(close).select("a", "b"), "edges")
    labels = connect(edges, scratch, "labels").withColumnRenamed("node", "m")
    rest = members.filter(F.col("node") != F.col("pivot"))
    rest = scratch.keep(rest.join(labels, rest.node == labels.m, "left").select("band", "node", "n", F.coalesce("label", "node").alias("label")), "rest")
    more = scratch.keep(compare_blocks(rest, texts, scratch, similarity), "more-edges")
    if not more.isEmpty():
        labels = connect(edges.unionByName(more), scratch, "all-labels").withColumnRenamed("node", "m")
    scratch.drop("texts", "nodes", "wanted", "shared", "members", "rest", "open", "open-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    by_node = sketched.filter("node is not null").groupBy("node").agg(first.alias("first"), F.count("*").alias("c"))
    named = by_node.join(labels, by_node.node == labels.m, "left").select("node", "first", "c", F.coalesce("label", "node").alias("label"))
    named = scratch.keep(named, "named")
    by_class = scratch.keep(named.groupBy("label").agg(F.min("first").alias("head"), F.sum("c").alias("class_size")), "classes")
    by_node = scratch.keep(named.join(by_class, "label").select(F.col("node").alias("m"), "head", "class_size"), "by-node")
    scratch.drop_all_but("sketch", "by-node")
    rows = sketched.select("doc_id", "text_hash", "node")
    out = rows.join(by_node, rows.node == by_node.m, "left")
    return out.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "text_hash", F.coalesce("head.text_hash", "text_hash").alias("first_hash"),
    )


def row_key(doc_id, text_hash):
    return F.xxhash64(doc_id, text_hash)


def keep_one(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """The documents less all but one of each class: that of the least doc_id (null last), and of these the least hash of its text.

    Documents that surely stay pass a filter of bounded size; only the others, with their texts, meet the rows that go.
    """
    found = scratch.keep(classes(docs, scratch, similarity).filter("class_size > 1"), "found")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("first_hash"))
    key = row_key("doc_id", "text_hash").alias("__key")
    gone = scratch.keep(found.filter(~stays).select(key).distinct(), "gone")
    again = scratch.keep(found.filter(stays).groupBy(key).count().filter("count > 1").select("__key"), "again")
    shared = docs.sparkSession.sparkContext.broadcast(HashFilter(gone.union(again)))
    scratch.drop_all_but("gone", "again")

    @F.pandas_udf("boolean")
    def named(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(keys.to_numpy(np.int64)))

    keyed = docs.withColumn("__key", row_key(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")))).withColumn("__named", named("__key"))
    rest = keyed.filter("__named").join(gone, "__key", "left_anti")
    if not again.isEmpty():  # of rows that repeat as a whole one stays
        rest = rest.join(again, "__key", "left_anti").unionByName(rest.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return keyed.filter(~F.col("__named")).unionByName(rest).select(*[column(c) for c in docs.columns])
