"""The operators on hard rows, and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import audio, brown, decontaminate, langid, mixing, neardup, preference, quality, queries, sharding, tokens
from tideline.llm.common import ALNUM, SOLID, Scratch, cut_long, find_words, running_sums, shingles, text_bytes, word_hashes

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, `_key` long, `a.b` string, part int, size string, class_id string"
rnd = random.Random(5)
VOCABULARY = ["alpha", "beta", "Gamma", "dél", "ß", "x1", "o'k", "zz."]
LONG = " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 99)) for _ in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven"
BASE = " ".join(f"w{i}" for i in range(100))
TEXTS = [
    None, "", "   \n\t", "!!! ???", "word", "Word", "a b c", "a b c", BASE, BASE, BASE + " more", BASE.replace("w50", "changed"), LONG, PASSAGE + " twelve", f"before {PASSAGE} after", "é è ü 日本語 🎉", "1 2 3",
    "tab\tand  two blanks \n\n end ", "it's we'll <|endoftext|> x", "und " * 400, "un" + "endlich" * 3000,
]


def rows_of(texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, ""][i % 4], None, 1, 2, "k", 3, "s", "c") for i, t in enumerate(texts)]
    return [*rows, (None, "no id", "en", "s1", 1, 1, 1, "k", 1, "s", "c"), rows[8], (8, "another text of the same id", "en", "s1", 1, 1, 1, "k", 1, "s", "c")]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    spark.createDataFrame(rows_of(TEXTS), COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(hard):
    return hard.filter("doc_id = -1")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))


def solid(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


# ------------------------------------------------------------------ shared helpers


def test_words_match_the_patterns():
    array = pa.array(TEXTS, pa.string())
    for kind, find in ((ALNUM, words), (SOLID, lambda t: solid(low(t)))):
        hashes, firsts = word_hashes(array, kind)
        expected = [find(t) for t in TEXTS]
        assert np.diff(firsts).tolist() == [len(e) for e in expected]
        flat = [w for e in expected for w in e]
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))


def test_slices_of_arrays_keep_their_texts():
    array = pa.array(["ab", None, "cde", ""], pa.string()).slice(1)
    data, offsets = text_bytes(array)
    assert data.tobytes() == b"cde" and offsets.tolist() == [0, 0, 3, 3]
    assert len(find_words(*text_bytes(pa.array([], pa.string())), ALNUM)[0]) == 0 and len(shingles(np.zeros(2, np.uint64), 5)) == 0


def test_long_texts_are_cut_between_words():
    r = random.Random(2)
    long = " ".join(r.choice(VOCABULARY) for _ in range(300_000)) + " " + "x" * 1_200_000 + " end " + "é" * 400_000 + " tail"
    array = pa.array(["short one", long, None, "", "a b"], pa.string())
    for may_cut in (tokens._before_word, langid._after_word):
        pieces, firsts = cut_long(array, may_cut)
        got = pieces.to_pylist()
        assert len(got) > 5 and firsts.tolist()[0] == 0 and firsts[-1] == len(got)
        assert ["".join(got[a:b]) for a, b in zip(firsts, firsts[1:])] == [t or "" for t in array.to_pylist()]
        assert max(map(len, got)) < 1_800_000
    coder = tokens.Encoder(queries.tokenizer_path())
    one, two = coder.encode(array), coder._encode(array)
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])
    assert cut_long(array.slice(2), tokens._before_word)[0].to_pylist() == [None, "", "a b"]


def test_rejection_gives_up_what_is_mostly_wrong():
    scores, right = np.linspace(0.3, 0.99, 70), np.ones(70, bool)
    assert langid.rejection(scores, right) == 0 and langid.rejection(scores[:0], right[:0]) == 0
    right[:8] = False
    assert langid.rejection(scores, right) == 0  # eight of eight may be chance
    right[[8, 9, 11]] = False
    assert langid.rejection(scores, right) == np.nextafter(scores[9], 2)  # ten of ten are not; eleven of twelve are no more than those
    right[:] = True
    right[:9] = False
    scores[8:20] = scores[8]
    assert langid.rejection(scores, right) == 0  # equal scores share their fate


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as k", "cast(if(id % 10 = 0, null, id) as long) as v").repartition(7)
    got = sorted(running_sums(df, ["k"], {"before": "v"}, Scratch(spark, "t"), "t").collect(), key=lambda r: r.k)
    total = 0
    for r in got:
        assert r.before == total
        total += r.v or 0


# ------------------------------------------------------------------ 1 token output


def test_pieces_match_the_library():
    e = tokens.Encoder(queries.tokenizer_path())
    odd = [*TEXTS, " ", "  a", "\n\n a", "'s", "'so it'll''ve !'s x's!", "don’t  　x", "²³½Ⅷ", "a​b", "'", "́a", "x'"]
    ids, counts = e.encode(pa.array(odd, pa.string()))
    ends = np.cumsum(counts)
    for t, a, b in zip(odd, ends - counts, ends):
        assert ids[a:b].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t
    e.forget()
    assert e.encode(pa.array(odd[3:6], pa.string()))[0].tolist() == [i for t in odd[3:6] for i in e.tokenizer.encode(t).ids]


def check_stream(docs, got):
    library, before = Tokenizer.from_file(queries.tokenizer_path()), 0
    expected = []
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        expected.append((r.doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected


def test_token_output_round_trip(spark, hard):
    written = tokens.write_tokens(hard, Scratch(spark, "t"), queries.tokenizer_path())
    check_stream(hard.collect(), tokens.crc_of_ids(tokens.stream_starts(written)).collect())
    narrow = tokens.metadata(written)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in narrow
    some = tokens.select_documents(written, 4, 6)
    assert "GreaterThanOrEqual(doc_id,4)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.doc_id for r in some.collect()}) == [4, 5, 6]


def test_files_are_delta_encoded_with_page_indexes(spark):
    rows = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(40))) for i in range(6_000)]
    scratch = Scratch(spark, "t")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch, queries.tokenizer_path())
    files = sorted(Path(scratch.path.removeprefix("file:") + "/tokens").glob("part-*.parquet"))
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * tokens.ROW_GROUP_BYTES
            for i in range(group.num_columns):
                c = group.column(i)
                assert c.has_column_index and c.has_offset_index, c.path_in_schema
                delta = "DELTA_BINARY_PACKED" in c.encodings
                assert delta if c.path_in_schema.startswith("tokens") else delta or any("DICTIONARY" in e for e in c.encodings), (c.path_in_schema, c.encodings)


def test_repeated_ids_are_dealt_to_several_tasks(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, f"text {i % 5}") for i in range(3_000)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = tokens.write_tokens(docs, Scratch(spark, "t"), queries.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_stream(docs.collect(), tokens.crc_of_ids(tokens.stream_starts(written)).collect())
    assert max(r["count"] for r in written.groupBy("part").count().collect()) < 2_000


def test_token_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_stream(docs, queries.op1_token_output(spark, SF).collect())


# ------------------------------------------------------------------ 2 decontamination


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(10, len(v))
        for a in range(len(v) - n + 1 if v else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(i)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_matches_brute_force(spark, hard):
    r = random.Random(9)
    texts = [t for t in TEXTS if t != LONG] + [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(40)]
    items = [("7", PASSAGE), ("12", "a b c"), ("3", " ".join(r.choice("ab") for _ in range(14))), ("x", None), ("y", ""), ("7", BASE[:60]), ("z", "und " * 30), ("", "ß 日本語")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items[:-1], (None, items[-1][1])], "item_id string, text string")
    for block in (2_000_000, 20):
        got = {x[0]: tuple(x[1:]) for x in decontaminate.decontaminate(docs, bench, block_words=block).collect()}
        for i, t in enumerate(texts):
            assert got[i] == brute_hits(t, items), (t, block)
    assert decontaminate.drop_contaminated(hard, bench).columns == hard.columns


# ------------------------------------------------------------------ 3 language model


def test_repetitive_texts_against_long_repetitive_items():
    index = decontaminate.Index(["a", "b"], ["und " * 10_000, "und " * 9 + "oder"])
    for text, n_hit, items in (("und " * 100_000, 100_000, {0}), ("und " * 9, 0, set()), ("x " + "und " * 9 + "oder", 10, {1}), ("und " * 12 + "oder x", 13, {0, 1})):
        w, firsts = word_hashes(pa.array([text]), ALNUM)
        hit, pairs = index.hits(w, firsts)
        assert hit.sum() == n_hit and {i for _, i in pairs.tolist()} == items


def test_base_scores_and_model(spark, hard, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 5)  # so that nearly all words go the way of those beyond the head
    got = brown.score(hard, Scratch(spark, "t")).collect()
    rows = hard.collect()
    held = lambda r: zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r) for w in [*solid(low(r.text)), None])
    n, v = sum(c.values()), len(c)
    expected = sorted((r.doc_id or -1, held(r), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for r in rows for t in [[*solid(low(r.text)), None]])
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_class_model_sums_to_one():
    r = np.random.default_rng(0)
    counts = r.integers(1, 9, 300)
    of = r.integers(0, brown.END - 1, 300)  # one class stays empty
    tokens_ = np.append(np.bincount(of, counts, brown.END), 40.0)
    table = r.random((brown.SIDES, brown.CLASSES))
    table *= tokens_ / table.sum(0)
    m = brown.Model(table, tokens_, np.bincount(of, minlength=brown.CLASSES), np.bincount(of[counts == 1], minlength=brown.CLASSES))
    words_ = np.bincount(of, (counts + 1) / 10 ** m.norm[of], brown.CLASSES)
    words_[m.unseen] += 1 / 10 ** m.norm[m.unseen]
    words_[brown.END] = 41 / 10 ** m.norm[brown.END]
    assert np.allclose((10**m.step) @ words_, 1)


def likelihood(cls, u, v, c, classes):
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (cls[u], cls[v]), c)
    x = lambda t: (t * np.log(np.maximum(t, 1))).sum()
    return x(table) - x(table.sum(0)) - x(table.sum(1))


def test_exchange_ends_where_no_move_helps():
    r = np.random.default_rng(1)
    group = r.integers(0, 2, 40)
    strong = np.where(group[:, None] != group[None, :], 20, 0) * (r.random((40, 40)) < 0.9)
    pairs = np.zeros((42, 42), np.int64)
    pairs[:40, :40] = strong
    cls, _ = brown.cluster(*np.nonzero(pairs), pairs[np.nonzero(pairs)], 40, classes=6)
    assert all(len(set(group[cls[:40] == k])) <= 1 for k in range(5)) and cls[40] == 6 and cls[41] == 5 and max(cls[:40]) < 5
    pairs = r.poisson(2, (14, 14)) * (r.random((14, 14)) < 0.6)
    u, v = np.nonzero(pairs)
    cls, table = brown.cluster(u, v, pairs[u, v], 12, classes=5)
    best = likelihood(cls, u, v, pairs[u, v], 5)
    again = np.zeros((6, 6))
    np.add.at(again, (cls[u], cls[v]), pairs[u, v])
    assert np.array_equal(again, table)
    for w in range(12):
        for b in range(4):
            other = cls.copy()
            other[w] = b
            assert likelihood(other, u, v, pairs[u, v], 5) <= best + 1e-5


def test_scores_match_brute_force(spark, monkeypatch):
    """Classes of all further words and scores, from plain counts of the texts."""
    monkeypatch.setattr(brown, "HEAD", 25)
    monkeypatch.setattr(brown, "TOP", 8)
    monkeypatch.setattr(brown, "MOST_HELD", 40)
    monkeypatch.setattr(brown, "ROWS", 16)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(90)]
    texts = [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(90)], k=r.randint(0, 60))) for _ in range(120)] + ["never seen words here"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    split = [(i, t.split(), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(texts)]
    n = Counter(w for _, t, held in split if not held for w in t)
    docs_n = sum(not held for *_, held in split)
    scratch = Scratch(spark, "t")
    rows = docs.withColumn("held_out", brown.remainder("doc_id", 7) == 2)
    counts = scratch.keep(brown.count_tokens(rows.filter("not held_out")), "counts")
    head, least = brown.learn_head(counts)
    encoded = scratch.keep(brown.encode(rows, spark.sparkContext.broadcast(head)), "encoded")
    model, classes, far = brown.learn(encoded.filter("not held_out"), counts, head, least, scratch)
    every = sorted({*n, "never", "seen", "words", "here"})
    name = dict(zip(word_hashes(pa.array(every), SOLID)[0].tolist(), every))
    number = {name[h]: int(i) for h, i in zip(head.h.tolist(), head.number)}
    assert len(number) <= 25 < len(n) and min(n[w] for w in number) == least > max(n[w] for w in n if w not in number)
    far_class = {name[x.word % 2**64]: x.cls for x in far.collect()}
    assert {*number, *far_class} == {*n} and all(x.c == n[name[x.word % 2**64]] for x in far.collect())
    cls = {w: int(classes[i]) for w, i in number.items()} | far_class
    end, rare, sides = brown.END, brown.RARE, brown.SIDES

    def fits(known):  # log(P(a, b) / (P(a) P(b))) of classes, smoothed
        table = np.zeros((sides, sides))
        for _, t, held in split:
            c = [end, *(known.get(w, rare) for w in t), end]
            for a, b in zip(c, c[1:]) if not held else ():
                table[a, b] += 1
        own = (table.sum(0) + 1) / (table.sum() + sides)
        return np.log((table + 5 * own) / (table.sum(1, keepdims=True) + 5) / own), table

    for some, known in (({w for w, i in number.items() if i >= 8}, {w: cls[w] for w, i in number.items() if i < 8}), (set(far_class), {w: cls[w] for w in number})):
        fit, table = fits(known)
        used = [b for b in range(end) if table[b].sum() + table[:, b].sum() > 0]
        score = {w: np.zeros(sides) for w in some}
        for _, t, held in split:
            c = [end, *(known.get(w, rare) for w in t), end]
            for i, w in enumerate(t) if not held else ():
                if w in some:
                    score[w] += fit[c[i]] + fit[:, c[i + 2]]
        for w in some:
            assert cls[w] in used and score[w][cls[w]] >= score[w][used].max() - 1e-9, w
    # the model
    after = Counter()
    history = lambda w: cls[w] if w in number else rare
    for _, t, held in split:
        for a, b in zip([end, *map(history, t)], [*(cls.get(w) for w in t), end]) if not held else ():
            after[a, b] += 1
    tokens_, inside, once = Counter(cls[w] for w in n for _ in range(n[w])), Counter(cls[w] for w in n), Counter(cls[w] for w in n if n[w] == 1)
    tokens_[end], unseen = docs_n, min(range(end), key=lambda b: (-once[b], b))
    n_types = {b: inside[b] + (b == unseen) + (b == end) for b in range(end + 1)}
    weight = {b: tokens_[b] + 1 if n_types[b] else 0 for b in n_types}
    own = {b: x / sum(weight.values()) for b, x in weight.items()}
    def p(a, b, count):
        total = sum(after[a, x] for x in n_types)
        return (after[a, b] + 5 * own[b]) / (total + 5) * (count + 1) / (tokens_[b] + n_types[b])
    got = {x.doc_id: x.score for x in brown.score(docs, Scratch(spark, "t")).collect()}
    for i, t, _ in split:
        a, total = end, 0.0
        for w in t:
            total += math.log10(p(a, cls.get(w, unseen), n[w]))
            a = history(w)
        assert math.isclose(got[i], total + math.log10(p(a, end, docs_n)), abs_tol=1e-6), i


def test_class_model_beats_words_alone(spark):
    got = [r for r in queries.op3_class_lm(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# ------------------------------------------------------------------ 4 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 3)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(np.array([n - 1]), n, 3)[0] == p[-1]


def test_shards(spark, hard):
    got = sharding.shard_rows(hard, Scratch(spark, "t"), shards=4).collect()
    again = sharding.shard_rows(hard.repartition(5), Scratch(spark, "t"), shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == hard.count()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(got) / 4) < 1
    assert {(r.size, r.text_crc32) for r in got} == {(len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in hard.collect()}


# ------------------------------------------------------------------ 5 quality, 8 language


def test_written_shards_hold_whole_documents_in_slot_order(spark, hard, tmp_path):
    got = sharding.write_shards(hard, Scratch(spark, "t"), str(tmp_path / "shards"), shards=3, slots_in_file=4)
    rows = got.collect()
    assert sorted(str([r[c] for c in hard.columns]) for r in rows) == sorted(str([r[c] for c in hard.columns]) for r in hard.collect())
    place = Counter((r.doc_id, len((r.text or "").encode()) + 1, r._shard, r._slot) for r in rows)
    assert place == Counter((r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard_rows(hard, Scratch(spark, "t"), shards=3).collect())
    for f in (tmp_path / "shards").glob("*/*.parquet"):
        slots = pq.ParquetFile(f).read(columns=["_slot"]).column(0).to_pylist()
        assert slots == sorted(slots)


def test_statistics_match_plain_counts():
    texts = [*TEXTS, "a b a b a b", "Only. Two!", "x" * 13 + " y", "a  b\nc\n\nd", "und und Und"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, got):
        raw = (t or "").encode()
        n, w = max(len(raw), 1), solid(t)
        k, lengths = max(len(w), 1), [len(x.encode()) for x in w]
        of = [sum(f(b) for b in raw) / n for f in (
            lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in (32, 9, 11, 12, 13), lambda b: b == 10, lambda b: b < 128 and not chr(b).isalnum() and b not in (9, 10, 11, 12, 13, 32, 127), lambda b: b >= 128)]
        lows = [low(x) for x in w]
        mean = sum(lengths) / k
        rest = [
            math.log1p(len(raw)), math.log1p(len(w)), mean, math.sqrt(max(sum(x * x for x in lengths) / k - mean**2, 0)), sum(x > 12 for x in lengths) / k, len(set(lows)) / k, len(set(zip(lows, lows[1:]))) / k,
            sum(a == b for a, b in zip(lows, lows[1:])) / k, sum("A" <= x[0] <= "Z" for x in w) / k, sum(x[-1] in map(chr, range(33, 127)) and not x[-1].isalnum() for x in w) / k, math.log1p(len(raw) / (raw.count(b"\n") + 1)), max(lengths, default=0) / n,
        ]
        marks = [raw.count(bytes([m])) / n for m in quality._MARKS]
        assert np.allclose(row, [*of, *rest, *marks], atol=1e-4), (t, list(zip(quality.STATISTICS, row, [*of, *rest, *marks])))


def test_forest_matches_a_walk_through_its_trees():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    forest = quality.train(x, y)
    for row, score in zip(x[:40], forest.score(x)):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 2 if row[feature[node]] > threshold[node] else 2 * node + 1
            total += leaf[node - (2**quality.DEPTH - 1)]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95


def test_quality(spark, hard):
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(3, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.filter("doc_id = -5")):
        got = quality.classify(hard, l, Scratch(spark, "t")).collect()
        assert len(got) == hard.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got} == {0.5}


def test_subwords_match_plain_grams():
    """Every word, and every two and three bytes within a word; one bucket for one subword."""
    def keys(text):
        k, doc = langid.subwords(pa.array([text]))
        assert not doc.any()
        return k.tolist()

    runs = lambda t: re.findall(b"[a-z\x80-\xff]+", low(t).encode())
    bucket = {}

    def gram(g):  # the bucket of two or three bytes, from a text of its own, in whatever order its subwords come
        if g not in bucket:
            text = g.decode("latin-1") if g.isascii() else None
            bucket[g] = None if text is None else (set(keys(text)), len(keys(text)))
        return bucket[g]

    for t in ["The cat, the dog", "a", "ab", "abc x-yz", "ABC abc", "12 34", "straße zu", ""]:
        words_, got = runs(t), keys(t)
        assert len(got) == sum(1 + max(0, len(w) - 1) + max(0, len(w) - 2) for w in words_)
        for w in words_:
            for g in [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]:
                if gram(g):
                    assert gram(g)[0] & set(got)
    assert Counter(keys("ab ab")) == Counter({k: 2 * n for k, n in Counter(keys("ab")).items()})
    both, doc = langid.subwords(pa.array(["one two", "two"]))
    assert sorted(both[doc == 1].tolist()) == sorted(keys("two")) and sorted(both[doc == 0].tolist()) == sorted(keys("one two"))


def test_language(spark, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs, langid.fit(docs)).collect()
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    mixed = langid.drop_rejected(hard, langid.fit(docs))
    assert mixed.columns == hard.columns
    for r in langid.identify(hard, langid.fit(docs), keep=["text"]).collect():
        has = any(c.isalpha() for c in r._keep_0 or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1 and (has or r.rejected)
    assert {r.lang_pred for r in langid.identify(hard, None).collect()} == {"und"}


# ------------------------------------------------------------------ 6 audio


def test_media_round_trip(spark, hard):
    media = audio.store_media(hard, Scratch(spark, "t"))
    got = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in audio.digest(media).collect()}
    seen = {}
    for r in hard.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        d = got[r.doc_id, len(raw), hashlib.sha256(p).hexdigest()]
        assert d.payload_bytes == len(p) and d.tail_crc32 == zlib.crc32(p[-64:]) and d.media_sha256 == hashlib.sha256(audio.to_wave(p)).hexdigest() and d.media_bytes == len(p) + 44
        assert seen.setdefault(p, d.feature) == d.feature
    f = audio.extract_features(media).collect()
    assert all(len(r.tensors) == len(r.window_spans) == -(-r.n_frames // audio.FRAMES) and {len(t) for t in r.tensors} == {audio.FRAMES * audio.MELS} for r in f)
    tensors = audio.as_tensors(pa.array(f[0].tensors, pa.list_(pa.float32())))
    assert tensors.to_numpy_ndarray().shape == (len(f[0].tensors), audio.FRAMES, audio.MELS)


def test_query_derives_features_from_stored_tensors(spark, hard, monkeypatch):
    kept = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, **o: kept.setdefault(name, keep(self, df, name, **o)))
    monkeypatch.setattr(queries, "table", lambda *_: hard)
    got = queries.op6_audio_media(spark, "")
    stored = next(df for df in kept.values() if "tensors" in df.columns)
    rows = stored.collect()
    assert len(rows) == hard.count()
    for r in rows:
        t = audio.from_cell(r.tensors)
        assert t.type == pa.fixed_shape_tensor(pa.float32(), (audio.FRAMES, audio.MELS), dim_names=("frame", "mel")) and len(t) == len(r.window_spans)
        mels, energy, rate = audio.log_mel(*audio.from_wave(bytes(r.media)))
        assert np.abs(t.to_numpy_ndarray() - audio.windows(mels)).max() < 1e-3 and [(x.start, x.end) for x in r.spans] == [(a / rate, b / rate) for a, b in audio.segments(energy)]
    short = {(r.media_sha256, r.feature) for r in got.collect()}
    assert short == {(r.media_sha256, r.feature) for r in audio.digest(stored.select("doc_id", "n_bytes", "media")).collect()}
    changed = stored.withColumn("tensors", F.lit(audio.to_cell(audio.as_tensors(pa.array([np.ones(audio.FRAMES * audio.MELS)], pa.list_(pa.float32()))))))
    assert all(r.feature.endswith(",".join(["1.00"] * audio.MELS)) for r in audio.digest(changed).collect())


def test_resampling_and_segments(monkeypatch):
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert audio.UP > 1 and len(y) == 16_000 * audio.UP // audio.DOWN
    assert np.abs(y[50:-50] - np.sin(2 * np.pi * 440 * np.arange(len(y)) * audio.DOWN / audio.UP / 16_000)[50:-50]).max() < 0.01
    assert np.abs(audio.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32))[50:-50]).max() < 0.05
    x = (128 + 100 * np.sin(np.arange(300_000) / 9)).astype(np.uint8).tobytes()
    whole = audio.log_mel(memoryview(x), 16_000)[0]
    monkeypatch.setattr(audio, "BLOCK", 37)
    assert np.abs(whole - audio.log_mel(memoryview(x), 16_000)[0]).max() < 1e-3
    energy = np.array([0, 0, 0, 0, 7, 4, 4, 2, 4, 0, 8, 0], float)
    assert audio.segments(energy) == [(4, 7), (10, 11)]  # 4 dB holds a segment but doesn't begin one
    with pytest.raises(ValueError):
        audio.from_wave(b"RIFF????AIFF")


@pytest.mark.parametrize("ratio", [(2, 5), (3, 4), (1, 2), (3, 2)])
def test_resampling_matches_plain_filtering(monkeypatch, ratio):
    """Zeros between the samples, one whole filter, every DOWN-th sample."""
    up, down = ratio
    monkeypatch.setattr(audio, "UP", up)
    monkeypatch.setattr(audio, "DOWN", down)
    monkeypatch.setattr(audio, "_BANK", audio._phases())
    r = np.random.default_rng(4)
    taps = audio.TAPS * max(up, down) - 1
    k = np.arange(taps) - taps // 2
    h = np.sinc(k / max(up, down)) * (0.54 + 0.46 * np.cos(2 * np.pi * k / (taps - 1)))
    h *= up / h.sum()
    for n in (1, 2, 63, 64, 640, 50_000):
        x = r.normal(size=n).astype(np.float32)
        full = np.zeros(n * up)
        full[::up] = x
        y = np.convolve(full, h)[taps // 2 :][: n * up : down]
        got = audio.resample(x)
        assert len(got) == len(y) and np.abs(got - y).max() < 1e-4, n


def test_log_mel_matches_plain_sums():
    r = np.random.default_rng(6)
    raw = r.integers(0, 256, 3_000).astype(np.uint8)
    mels, energy, rate = audio.log_mel(memoryview(raw.tobytes()), 16_000)
    y = audio.resample(raw.astype(np.float32) / 128 - 1)
    low = audio.UP * 16_000 / audio.DOWN
    points = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * math.log10(1 + low / 2 / 700), audio.MELS + 2)]
    assert rate == low / audio.HOP and len(mels) == 1 + -(-(len(y) - audio.FRAME) // audio.HOP)
    for i in (0, 3, len(mels) - 1):
        frame = np.zeros(audio.FRAME)
        part = y[i * audio.HOP :][: audio.FRAME]
        frame[: len(part)] = part
        assert abs(energy[i] - 10 * math.log10((frame**2).mean() + 1e-8)) < 1e-3
        turned = frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1)))
        for m in (0, 7, audio.MELS - 1):
            total = 0.0
            for b in range(audio.FFT // 2 + 1):
                f = b * low / audio.FFT
                weight = max(0.0, min((f - points[m]) / (points[m + 1] - points[m]), (points[m + 2] - f) / (points[m + 2] - points[m + 1])))
                if weight:
                    total += weight * abs((turned * np.exp(-2j * np.pi * b * np.arange(audio.FRAME) / audio.FFT)).sum()) ** 2
            assert abs(mels[i, m] - math.log(total + 1e-6)) < 1e-2


# ------------------------------------------------------------------ 7 mixing


def fill(sizes, weights):
    """Targets by turns: what is above three times a source's size goes to the others."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 3 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    r = random.Random(seed)
    docs = [(i, "w " * r.choice([0, 1, 5, 60, 300]), r.choice(["a", "b", "b", "b", "c", "ü", None, "z"])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, Scratch(spark, "t")).collect()
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(solid(d[1])) for d in docs if d[2] == s) for s in names]
    target = dict(zip(names, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for s, size in zip(names, sizes):
        own = [x for x in got if x.source == s]
        assert all(x.source_size == size and abs(x.target - target[s]) < 1e-6 * size + 1e-6 for x in own)
        assert abs(sum(x.taken for x in own) - target[s]) < 0.02 * target[s] + 12
    assert all(0 <= x.taken <= 3 * x.size for x in got) and len(got) == len(docs)
    assert sorted(map(tuple, mixing.mix(df.repartition(7), Scratch(spark, "t")).select("doc_id", "taken").collect())) == sorted((x.doc_id, x.taken) for x in got)


def test_schedule_stays_near_the_targets(spark):
    shares = spark.createDataFrame([(0, 500), (1, 0), (2, 300), (3, 200)], "place long, slots long")
    got = sorted(mixing.schedule(mixing.slot_edges(shares, Scratch(spark, "t")), Scratch(spark, "t")).collect())
    assert [r.slot for r in got] == list(range(1000))
    for n in (50, 200, 1000):
        c = Counter(r.place for r in got[:n])
        assert c[1] == 0 and all(abs(c[p] - n * w / 1000) < 6 for p, w in ((0, 500), (2, 300), (3, 200)))


def test_pieces_fill_blocks(spark):
    docs = [(i, "w " * (7 * i % 23), "abc"[i % 3]) for i in range(60)]
    scratch = Scratch(spark, "t")
    placed, shares = mixing.place_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), scratch)
    pieces = mixing.mix_pieces(placed, shares, scratch, 10).collect()
    by_slot = Counter()
    for p in pieces:
        by_slot[p.slot] += p.last - p.first
    size = {r.place: r.source_size for r in shares.collect()}
    assert all(n == 10 for n in by_slot.values() if n > 10) and sum(n < 10 for n in by_slot.values()) <= 3 * len(size)
    runs = {}
    for p in sorted(pieces, key=lambda p: (p.place, p.slot, p.at)):
        runs.setdefault(p.place, []).append(p)
    for place, run in runs.items():  # a source's slots go through its stream in order, again and again
        at = [p.at + p.first for p in run]
        assert all(b == a + q.last - q.first or b == 0 for a, b, q in zip(at, at[1:], run))


def test_small_sources_take_their_targets(spark, monkeypatch):
    docs = [(i, "w " * 20, "a") for i in range(10)] + [(i, "w " * 7, "b") for i in range(10, 11)] + [(i, "w " * 300, "c") for i in range(20, 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 1_024)  # as in a large corpus
    got = mixing.mix(df, Scratch(spark, "t")).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    target = {r.source: r.target for r in got}
    assert target["a"] == 600 and target["b"] == 21 and all(taken[s] == math.ceil(t - 1e-9) for s, t in target.items())
    whole = Counter(r.doc_id for r in mixing.mix_documents(df, Scratch(spark, "t")).collect())
    assert all(whole[i] == 3 for i in range(11))


def test_points_keep_their_low_bits():
    slots = pa.record_batch([pa.array([0, 1, 10**10, 10**10 + 1])], ["id"])
    at = next(mixing._points(iter([slots]))).column("at").to_pylist()
    assert [a + 2**63 for a in at] == [(i * mixing.GOLDEN + mixing.GOLDEN // 2) % 2**64 for i in (0, 1, 10**10, 10**10 + 1)]


@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_whole_documents_of_any_id_come_near_the_targets(spark, kind):
    docs = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id") if kind == "string" else F.col("doc_id").cast(kind))
    whole = mixing.mix_documents(df, Scratch(spark, "t")).collect()
    size = sum(len(solid(t)) for _, t, _ in docs)
    for s, w in zip("abc", (5, 2, 1)):
        taken = sum(len(solid(r.text)) for r in whole if r.source == s)
        assert abs(taken - size * w / 8) < 0.05 * size * w / 8 + 40, s


def test_whole_documents_are_those_whose_first_words_are_taken(spark, hard):
    r = random.Random(8)
    docs = [(i, " w" * r.choice([0, 1, 3, 40]), r.choice(["a", "b", "c", None, "d"])) for i in range(400)]
    df = spark.createDataFrame([*docs, *docs[:5]], "doc_id long, text string, source string")
    for table in (df, hard):
        passes = Counter()
        for x in mixing.mix(table, Scratch(spark, "t")).collect():
            passes[x.doc_id, x.key, x.passes] += 1
        want = Counter()
        for i, key in {(i, k) for i, k, _ in passes}:
            same = [(p, n) for (a, b, p), n in passes.items() if (a, b) == (i, key)]
            want[i] += max(p for p, _ in same) * sum(n for _, n in same)
        got = Counter(x.doc_id for x in mixing.mix_documents(table, Scratch(spark, "t")).collect())
        assert got == +want


def test_mix_of_hard_rows(spark, hard):
    got = mixing.mix(hard, Scratch(spark, "t")).collect()
    assert sorted(r.size for r in got) == sorted(len(solid(r.text)) for r in hard.collect())
    whole = mixing.mix_documents(hard, Scratch(spark, "t"))
    assert whole.columns == hard.columns and whole.count() > 0
    none = hard.filter("doc_id < 2")
    assert {r.taken for r in mixing.mix(none, Scratch(spark, "t")).collect()} == {0}


# ------------------------------------------------------------------ 9 preference


def test_preference_on_hard_rows(spark):
    rows = [
        (0, 0, "system", "s"), (0, 1, "user", "hé"), (0, 2, "assistant", "A"), (0, 3, "user", "trail"), (1, 0, "user", "x"), (1, 1, "assistant", "B"), (1, 1, "assistant", "B"), (2, 0, "user", "alone"),
        (3, 0, None, None), (4, None, "assistant", ""), (None, 0, "assistant", "lost"), (None, None, "user", "lost"), (None, None, "user", "lost"), (None, None, "user", "also lost"), (10, 1, "assistant", "early"), (10, 5000, "assistant", "late"), (10, 3000, "user", "between"), (11, 0, "assistant", "other"), (6, 0, "assistant", "same"), (7, 0, "assistant", "same"), (8, 5, "assistant", "one"), (8, 5, "assistant", "two"), (9, 2000, "assistant", "far"), (9, 1, "user", "near"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    got = preference.format_pairs(preference.swapped_replies(df, Scratch(spark, "t")), Scratch(spark, "t"))
    c = duckdb.connect()
    table = pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    c.register("conversations", table)
    expected = c.execute(preference.SWAPPED_SQL)
    names = [d[0] for d in expected.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, expected.fetchall()))
    first = [r for r in got.collect() if r.pair_id == 0][0]
    assert first.prompt == "<|system|>\ns<|end|>\n<|user|>\nhé<|end|>\n" and first.rejected == "<|assistant|>\nB<|end|>\n" and first.rejected_spans == "14:9"
    assert first.chosen == "<|assistant|>\nA<|end|>\n<|user|>\ntrail<|end|>\n" and first.chosen_spans == "14:9"


def test_pairs_of_two_tables(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "only chosen")]
    chosen = spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "why")], chosen.schema)
    got = {r.pair_id: r for r in preference.preference_pairs(chosen, rejected, Scratch(spark, "t")).collect()}
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == ("<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n<|user|>\nwhy<|end|>\n")
    assert got[1].rejected_spans == "14:11" and got[2].rejected == "" and got[2].differs


def test_spans_of_long_completions_are_absolute(spark):
    chosen = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"turn {t} é") for t in range(0, 5000, 7)], "pair_id long, turn long, role string, text string")
    rejected = spark.createDataFrame([(1, 14, "assistant", "no")], chosen.schema)
    got = sorted(preference.preference_pairs(chosen, rejected, Scratch(spark, "t")).collect(), key=lambda r: r.segment)
    assert len(got) == 5
    whole = "".join(r.chosen for r in got)
    spans = [tuple(map(int, x.split(":"))) for r in got for x in r.chosen_spans.split(",") if x]
    assert [whole[a : a + n] for a, n in spans] == [f"turn {t} é<|end|>\n" for t in range(0, 5000, 7) if t % 2]


def test_preference_of_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.swapped_replies(none, Scratch(spark, "t")), Scratch(spark, "t")).count() == 0


# ------------------------------------------------------------------ 10 near duplicates


@pytest.mark.parametrize("weighted", [False, True])
def test_darts_estimate_similarity(weighted):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    for share in (0.0, 0.1, 0.5):
        n = int(300 * (1 - share))
        other = np.concatenate([base[:n], r.integers(0, 2**63, 300 - n, dtype=np.uint64)])
        wa = r.uniform(0.2, 3, 300) if weighted else np.ones(300)
        wb = np.concatenate([wa[:n] * (1.3 if weighted else 1), r.uniform(0.2, 3, 300 - n) if weighted else np.ones(300 - n)])
        a, b = dict(zip(base.tolist(), wa)), dict(zip(other.tolist(), wb))
        exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        s = neardup.dart_signatures(np.concatenate([base, other]), np.concatenate([wa, wb]) if weighted else None, np.repeat([0, 1], 300), 2, k=1500)
        assert abs((s[0] == s[1]).mean() - exact) < 0.05


def brute_classes(rows, counted=False):
    sets = []
    for _, t in rows:
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        sets.append(Counter(grams) if counted else Counter(set(grams)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if sets[i] and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))]


@pytest.mark.parametrize("weights", ["set", "count"])
def test_classes_match_brute_force(spark, weights):
    r = random.Random(11)
    texts, seeds = [], [[f"s{k}w{i}" for i in range(60)] for k in range(4)]
    for _ in range(90):
        w = list(r.choice(seeds))
        for _ in range(r.choice([0, 1, 2, 8])):
            w[r.randrange(len(w))] = r.choice("xyz")
        texts.append(" ".join(w[: r.choice([60, 60, 57, 40])]))
    rows = list(enumerate([*texts, *[t for t in TEXTS if t != LONG]]))
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), weights=weights).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows, weights == "count")


def test_recall_over_the_documents(spark):
    """Ids divisible by 100 against all rows: pairs of similarity 0.8 that lie in one class, by exact counts."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.class_id for r in queries.op10_near_duplicates(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bags = {}
    for r in rows:
        w = words(r.text)
        bags[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    holders = {}
    for i, bag in bags.items():
        for g in bag:
            holders.setdefault(g, []).append(i)
    close = together = 0
    for i in bags:
        if i % 100 == 0:
            both = Counter()
            for g, n in bags[i].items():
                for j in holders[g]:
                    both[j] += min(n, bags[j][g])
            for j, n in both.items():
                if j != i and n >= 0.8 * (bags[i].total() + bags[j].total() - n):
                    close, together = close + 1, together + (got[i] == got[j])
    assert close and together >= 0.9 * close


def test_one_of_each_class_stays(spark, hard):
    kept = neardup.keep_one(hard, Scratch(spark, "t"))
    rows = kept.select("doc_id", "text").collect()
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted([0, 1, 2, 3, 4, 6, 8, 8, 12, 13, 14, 15, 16, 17, 18, 19, 20])


# ------------------------------------------------------------------ empty tables and the pipeline


def test_empty_tables(spark, empty):
    s = lambda: Scratch(spark, "t")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id string, text string")
    frames = [
        tokens.crc_of_ids(tokens.stream_starts(tokens.write_tokens(empty, s(), queries.tokenizer_path()))), decontaminate.decontaminate(empty, bench), brown.score(empty, s()), sharding.shard_rows(empty, s()),
        quality.classify(empty, labels, s()), audio.digest(audio.store_media(empty, s())), mixing.mix(empty, s()), langid.identify(empty, langid.fit(empty)), neardup.classes(empty, s()), mixing.mix_documents(empty, s()), neardup.keep_one(empty, s()),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_on_hard_rows_and_an_empty_table(spark, hard, tmp_path):
    import corpus_pipeline

    rows = [(*r[:2], "de" if i % 2 else "en", *r[3:]) for i, r in enumerate(rows_of([*TEXTS, *[f"these are plain words number {i} of a clean text that anyone may read in some language {i * 7}" for i in range(60)]]))]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [("1", PASSAGE), ("2", None), (None, "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        was, now = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        assert {r[:2] for r in now} <= {r[:2] for r in was}
        if name == "near_duplicates":
            label = brute_classes([(i, r[1]) for i, r in enumerate(was)], counted=True)
            wordless = [not words(r[1]) for r in was]
            assert len(now) == len({*(x for x, w in zip(label, wordless) if not w)}) + sum(wordless)
        if name == "decontamination":
            assert sorted(map(str, now)) == sorted(str(r) for r in was if not brute_hits(r[1], items[:1])[4])
        if name == "mixture":
            names = sorted({r[3] for r in was}, key=lambda s: (s is None, s or ""))
            sizes = [sum(len(solid(r[1])) for r in was if r[3] == s) for s in names]
            for s, target in zip(names, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
                longest = max(len(solid(r[1])) for r in was if r[3] == s)
                assert abs(sum(len(solid(r[1])) for r in now if r[3] == s) - target) <= 3 * longest, s
        docs = out
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in final) == sorted(str(r.doc_id) for r in docs.collect())
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = corpus_pipeline.language(spark, docs, SF)
    kept = corpus_pipeline.near_duplicates(spark, named, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(rows, counted=True)) & {r.doc_id for r in named.collect()})
    clean = corpus_pipeline.decontamination(spark, kept, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("cast(item_id as string) item_id", "text").collect()]
    texts = dict(rows)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in kept.collect() if not brute_hits(texts[r.doc_id], items)[4])
    assert clean.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in clean.collect()}
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
