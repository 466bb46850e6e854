"""The ten operators against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import castore, crossparse, decontam, editcount, histsort, lpf, packing, quality, replytree, setsketch, wordcodes
from lexiforge.llm.common import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(rng, n):
    return " ".join("".join(rng.choice("aeioubcdst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _corpus():
    """Plain, empty, null, repeated, near-equal, long and odd texts."""
    rng = random.Random(5)
    base, passage = _words(rng, 120), _words(rng, 90)
    near = base.split()
    near[60] = "other"
    texts = [
        base, base, " ".join(near), None, "", " \n ", "one", "One", "x ### $$$ <b> | |", _words(rng, 30) + " " + passage + " " + _words(rng, 40), passage + ".\n" + _words(rng, 10),
        _words(rng, 6000), "Line one here.\nLine one here.\n" + _words(rng, 25), "été naïve “quoted” 你好。你 <|endoftext|> don't, 3.14kg", _words(rng, 8) * 6, _words(rng, 200), _words(rng, 200),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(0, base, "en", "s", len(base))]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x, *_ in rows}


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_memo_is_exact():
    memo = wordcodes.BpeWords(vocabulary_path("word_bpe_49k.json"), capacity=50)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB .,!'’éÉ<|>ſİ1²\n\t́s") for _ in range(60)) for _ in range(200)] + ["<|endoftext|> a<|ENDOFTEXT|>b", "", "ΑΣ. x,"]
    got, edges = memo.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert got[edges[i] : edges[i + 1]].tolist() == memo.tokenizer.encode(t, add_special_tokens=False).ids


def test_fertility(spark, docs, rows):
    got = quality.fertility(docs.withColumn("kept", F.lit("clash")), keep=["doc_id", "kept"]).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = len({p for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), repeat, len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w))
        assert r.kept == (r.reason is None)
    assert quality.fertility(_empty(spark)).count() == 0


def test_packing(spark, docs, rows, ids):
    got = packing.pack(docs, seq_len=512, block_sequences=4).collect()
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, *_ in rows)
    seqs = collections.defaultdict(list)
    for r in got:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512 and (at & (at - 1)) == 0  # full or a power of two
    assert packing.pack(_empty(spark)).count() == 0


def test_packing_prefers_the_cheapest_sequence():
    pieces, cost = packing.assign(np.array([60, 40, 30, 30, 20, 20]), 100, 1.0, 0.01)
    assert sum(p[2] for p in pieces) == 200 and max(cost) / min(cost) < 1.3


def test_leaks(spark):
    items = [(1, "If Anna has 12 apples and buys 7 more apples at the old market, how many apples does Anna have in the end?"), (2, "The quick brown fox jumps over the lazy dog near the quiet river bank today."), (3, "Too short."), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng = random.Random(2)
    texts = [
        _words(rng, 50) + " " + items[1][1] + " " + _words(rng, 50), items[1][1].upper(), "Well: if Mario has 35 apples and buys 9 more apples at the old market, how many apples does Mario have in the end?",
        "Well: if Mario has 35 apples and buys 9 more apples at the old market, how many apples does Luigi have in the end? " + _words(rng, 5), _words(rng, 300), "", None, "Too short.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1_000_000, 0):
        got = {(r.doc_id, r.item_id, r.kind) for r in decontam.leaks(docs, bench, most_held=most).collect()}
        assert {(0, 2, "literal"), (1, 2, "literal")} <= got
        assert {(d, i) for d, i, _ in got} >= {(2, 1)} and not any(d in (4, 5, 6, 7) for d, *_ in got)
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_names_that_open_sentences(spark):
    items = [(1, "Tom has 5 apples. Tom buys 3 more apples at the market. How many apples does Tom have?"), (2, "Ruth sold 40 eggs on the first day. She sold 12 more on the second day."), (3, "Tom sold 5 apples to me. Tom bought 3 pears from me. Tom ate 2 of them. Tom slept.")]
    texts = [
        "Mia has 8 apples. Mia buys 2 more apples at the market. How many apples does Mia have?", "Note, Mia has 8 apples. Mia buys 2 more apples at the market. How many apples does Mia have?",
        "So. Paul sold 35 eggs on the first day. He sold 19 more on the second day.", "Mia sold 8 apples to me. Ben bought 4 pears from me. Eva ate 7 of them. Ida slept.",
    ]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1_000_000, 0):
        assert sorted(map(tuple, decontam.leaks(docs, bench, most_held=most).select("doc_id", "item_id", "kind").collect())) == [(0, 1, "template"), (1, 1, "template"), (2, 2, "template")]


def test_leaks_of_items_dense_or_thin_with_slots(spark):
    long = "one plain old sentence follows with many words and no figure in it at all"
    items = [(1, "Convert 12 kg, 7 kg, 9 kg and 14 kg to pounds."), (2, "is 12 kg over 20 lb?"), (3, "12 kg 7 cm 9 mm 14 km 3 m"), (4, f"a jar holds 12 sweets, {long} today")]
    texts = [
        "Please convert 3 kg, 5 kg, 8 kg and 21 kg to pounds.", "say, is 3 kg over 5 lb?", "3 kg 5 cm 8 mm 2 km 9 m", "12 kg 7 cm 9 mm 14 km 3 m", "we have 3 kg, 5 kg, 8 kg and 21 kg of it",
        "a jar holds 99 sweets, one plain old sentence follows with many words and, as if", "a jar holds 99 sweets, as if",
    ]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench, most_held=most).collect()}
        assert {k: r.kind for k, r in got.items()} == {(0, 1): "template", (1, 2): "template", (3, 3): "literal", (5, 4): "template"}
        assert all(0 < r.coverage <= 1 for r in got.values())


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats(spark, docs, rows, keep):
    length = 60
    once = {}
    for i, t, *_ in rows:
        once[t or ""] = min(i, once.get(t or "", i))
    order = sorted(once, key=once.get)
    many = collections.Counter(t or "" for _, t, *_ in rows)
    seen, total = set(), collections.Counter()
    windows = {t: [t.encode()[k : k + length] for k in range(len(t.encode()) - length + 1)] for t in order}
    for t in order:
        total.update(windows[t])
    got = {r.tid: r for r in lpf.judge_texts(docs, length=length, keep=keep, most_classes=2).collect()}
    tid = {t: hashlib.md5(t.encode()).digest() for t in order}
    for t in order:
        data, marked = t.encode(), set()
        for k, w in enumerate(windows[t]):
            if w in seen if keep == "first" else total[w] > 1 or many[t] > 1:
                marked.update(range(k, k + length))
            seen.add(w)
        kept = bytes(b for k, b in enumerate(data) if k not in marked)
        assert got[tid[t]].kept == kept and got[tid[t]].n_removed == len(marked)
    assert lpf.judge_texts(_empty(spark)).count() == 0


def test_repeated_words(spark):
    rng = random.Random(8)
    passage = _words(rng, 53).split()
    texts = [
        _words(rng, 30) + " " + " ".join(passage) + " " + _words(rng, 40), "\n".join(passage).upper() + " " + _words(rng, 9), _words(rng, 12) + " " + " ".join(passage[:50]) + " " + _words(rng, 12),
        _words(rng, 300), None, "", "same " * 51, "a b", "a b", _words(rng, 60),
    ]
    texts.append(texts[-1])
    got = {r.doc_id: r.n_passage_words for r in lpf.repeated_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lists = [(t or "").lower().split() for t in texts]
    windows = collections.Counter(tuple(w[k : k + 51]) for w in lists for k in range(len(w) - 50))
    for i, w in enumerate(lists):
        assert got[i] == len({p for k in range(len(w) - 50) if windows[tuple(w[k : k + 51])] > 1 for p in range(k, k + 51)}), i
    assert got[0] == got[1] == 53 and got[2] == 0 and got[9] == 60


@pytest.mark.parametrize("cap", [16, 40, 60])
def test_longest_previous_factors(cap):
    rng = random.Random(cap)
    for alphabet in (b"ab", b"abcdefgh", b"a"):
        data = bytes(rng.choice(alphabet) for _ in range(300)) + b"abcabcabc" * 12
        buf, starts = np.frombuffer(data, np.uint8), np.arange(len(data) - cap + 1)
        got, source = lpf.longest_previous_factors(buf, starts, cap)
        for i in starts.tolist():
            best = 0
            for j in range(i):
                n = 0
                while n < cap and data[j + n] == data[i + n]:
                    n += 1
                best = max(best, n)
            assert got[i] == best and (not best or source[i] < i and data[source[i] : source[i] + best] == data[i : i + best])


def test_histogram_sort(spark, docs, rows):
    got = histsort.histogram_sort(docs.withColumn("slot", F.lit(1)), "doc_id", shards=5, cells=3).collect()
    size = lambda t: len((t or "").encode()) + 8
    total = sum(size(t) for _, t, *_ in rows)
    below, slots = 0, collections.Counter()
    for r in sorted(got, key=lambda r: (r.doc_id, r.shard, r.slot)):
        assert r["size"] == size(r.text) and r.slot == slots[r.shard]
        if r.doc_id > 0:
            assert r.shard == below * 5 // total
        slots[r.shard] += 1
        below += r["size"]
    assert histsort.histogram_sort(_empty(spark), "doc_id").count() == 0


def test_histogram_sort_has_as_many_ranges_as_the_bytes_ask_for(spark):
    df = spark.range(2000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    got = histsort.histogram_sort(df, "id", shards=3, range_bytes=500).orderBy("id").collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(x == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    wide = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "b"), (None, "c"), (0, None)], "k long, text string")
    assert histsort.histogram_sort(wide, "k", shards=4).count() == 4


def test_histogram_sort_splits_a_hot_key(spark):
    df = spark.range(900).select(F.lit(7).cast("long").alias("k"), F.concat(F.lit("text "), "id").alias("text"), "id")
    sizes = histsort.histogram_sort(df, "k", shards=6).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(sizes) == 6 and max(r.n for r in sizes) < 1.1 * min(r.n for r in sizes)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    bases = [_words(rng, 60).split() for _ in range(12)]
    texts = [None, "", "word", "WORD", " \t"]
    for b in bases:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice("pqr")
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in setsketch.near_duplicates(df, k=k, block=1000).collect()}
    assert {i: got[i].component_id for i in got} == {i: find(i) for i in range(len(texts))}
    assert all(got[i].n_shingles == len(s) for i, s in enumerate(sets))
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimate_is_near_the_overlap():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.sort(np.concatenate([both, x])) for x in (a, b)]
    regs = setsketch.registers(np.concatenate(sets), np.array([0, 900, 1800]))
    merged = setsketch.registers(np.sort(np.concatenate([both, a, b])), np.array([0, 1000]))
    assert (np.maximum(regs[0], regs[1]) == merged[0]).all()
    j = setsketch.estimate(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([900.0]), np.array([900.0]))
    assert abs(j[0] - 0.8) < 0.12
    more, less, n_a, n_b = (rng.integers(1, 70, 500), rng.integers(1, 70, 500), rng.integers(50, 90, 500).astype(float), rng.integers(50, 90, 500).astype(float))
    j = setsketch.estimate(more, less, n_a, n_b)
    for floor in (0.4, 0.64, 0.7):
        got = setsketch.reaches(more, less, n_a, n_b, floor)
        assert (got == (j >= floor))[abs(j - floor) > 1e-4].all() and 0 < got.sum() < 500


def test_a_block_tells_one_link_for_each_two_components():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**62, 100)
    sets = [np.sort(np.concatenate([base[: 100 - 5 * i], rng.integers(1, 2**62, 5 * i)])) for i in (0, 1, 1, 2, 4)]
    regs = setsketch.registers(np.concatenate(sets).astype(np.uint64), np.arange(6) * 100)
    rows = setsketch.Members(np.arange(5), np.arange(5), np.full(5, 100), regs, sets)
    links = setsketch.links_of_block(rows, rows, 0, 80, 0.5)
    assert len(links) == 3 and {x for a in links for x in a} == {0, 1, 2, 3}  # node 4 is below 0.8 of every other


def test_cross_parsing(spark):
    def naive(text, sample):
        n = i = 0
        while i < len(text):
            m = 1
            while i + m < len(text) and text[i : i + m + 1] in sample:
                m += 1
            n, i = n + 1, i + m
        return n

    letters, table = crossparse.suffix_automaton("abracadabra")
    words = ["abra", "cad", "zzz", "brabrac", ""]
    codes = np.array([ord(c) for c in "".join(words)], np.int64)
    ends = np.cumsum([len(w) for w in words])
    assert crossparse.count_phrases(letters, table, codes, ends - [len(w) for w in words], ends).tolist() == [naive(w, "abracadabra") for w in words]
    rng = random.Random(4)
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(60))
    train = spark.createDataFrame([(make("abcde"), "x") for _ in range(20)] + [(make("defgh"), "y") for _ in range(20)], "text string, lang string")
    trained = crossparse.train(train)
    tests = [(0, make("abcde")), (1, make("defgh")), (2, None), (3, ""), (4, "123 !!")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in crossparse.identify(spark.createDataFrame(tests, "doc_id long, text string"), trained).collect()}
    assert [got[i][0] for i in range(5)] == ["x", "y", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in crossparse.identify(spark.createDataFrame(tests, "doc_id long, text string"), []).collect()} == {"und"}


def test_cross_parsing_samples_distinct_texts(spark):
    copies = [(f"copied text {k} of label", f"c{k}") for k in range(12) for _ in range(300)]
    many = [(f"number {k}", "m") for k in range(300)] + [("hot text", "m")] * 900
    trained = {label: letters for label, letters, _ in crossparse.train(spark.createDataFrame(copies + many, "text string, lang string"), sample_rows=20)}
    assert set(trained) == {"m", *(f"c{k}" for k in range(12))}
    rows = spark.createDataFrame([(f"number {k}", "m") for k in range(300)] + [("hot text", "m")], "text string, lang string")
    one = crossparse.train(rows, sample_rows=20)
    again = crossparse.train(spark.createDataFrame(many, "text string, lang string"), sample_rows=20)
    assert [(a, b, c.tolist()) for a, b, c in one] == [(a, b, c.tolist()) for a, b, c in again]
    # some labels have no hash that passes the filter
    sparse = spark.range(20_000).select(F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 200).cast("string").alias("lang"))
    assert len(crossparse.train(sparse, sample_rows=1)) == 200


def test_store_round_trip(spark, docs, rows, ids):
    path = castore.new_store(docs)
    at = 0
    got = sorted(castore.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    for r in got:
        assert r.start == at and r.n_tokens == len(ids[r.doc_id]) and r.ids == ids[r.doc_id].tobytes()
        at += r.n_tokens
    addresses = [r.address for r in spark.read.parquet(f"{path}/stored").where("kind = 'chunk'").collect()]
    assert len(addresses) == len(set(addresses))
    empty = castore.new_store(_empty(spark))
    assert castore.read_store(spark, empty).count() == 0


def test_store_refuses_ids_beyond_its_width(spark, docs, tmp_path):
    with pytest.raises(Exception, match="does not fit width <u2"):
        castore.write_store(docs, f"{tmp_path}/narrow", end_id=70_000)
    castore.write_store(docs, f"{tmp_path}/wide", end_id=70_000, width="<u4")
    assert {np.frombuffer(r.ids, "<u4")[-1] for r in castore.read_store(spark, f"{tmp_path}/wide", "<u4").collect()} == {70_000}


def test_cut_points_follow_content():
    rng = np.random.default_rng(2)
    tail = rng.integers(0, 40000, 6000).astype(np.uint32)
    a, b = (np.concatenate([rng.integers(0, 40000, n).astype(np.uint32), tail]) for n in (700, 1900))
    ends = lambda x, n: {e - n for e in castore.cut_points(x)}
    assert len(ends(a, 700) & ends(b, 1900)) > 3


def test_edits(spark, rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    rng = random.Random(6)
    edits = {}
    for i, text, *_ in rows:
        n = len(text or "")
        edits[i] = [(rng.randint(0, n + 3), rng.randint(0, 9), rng.choice(["", "new", " two words ", "x."])) for _ in range(rng.randint(0, 5))]
    table = spark.createDataFrame([(i, [dict(zip(("at", "cut", "put"), e, strict=True)) for e in x]) for i, x in edits.items()], "doc_id long, edits array<struct<at:int,cut:int,put:string>>")
    done = editcount.apply_edits(editcount.build_trees(docs, leaf_words=4).join(table, "doc_id"))
    for r in done.collect():
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
        assert r.n_tokens == count(r.text or "") and r.n_tokens_after == count(r.edited_text) == r.tree_after[1]
    assert editcount.build_trees(_empty(spark)).count() == 0


def test_reply_trees(spark):
    control = "</s>[INST] ok [/INST] <\\s> << <</x>> [\\INST]"
    rows = [
        (1, 1, None, "user", control, 0.0), (1, 2, 1, "assistant", control, 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", None, 5.0), (1, 5, 4, None, "leaf", 0.0), (2, 1, None, "a>>b", "x", None),
    ]
    tree = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.tree_id, r.branch): r for r in replytree.format_paths(tree).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and got[1, 1].leaf_id == 5
    assert replytree.parse(got[1, 1].formatted) == [("user", control), ("assistant", control), ("user", ""), ("none", "leaf")]
    assert replytree.parse(got[2, 1].formatted) == [("a>>b", "x")]
    back = {(r.tree_id, r.branch): r for r in replytree.read_back(replytree.format_paths(tree, best=1)).collect()}
    assert back[1, 1].loss_sha256 == hashlib.sha256(control.encode()).hexdigest() and back[1, 1].loss_chars == len(control)
    long = spark.range(40).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    chain = replytree.format_paths(replytree.chain_by_turn(long)).collect()
    assert len(chain) == 1 and [x for _, x in replytree.parse(chain[0].formatted)] == [str(i) for i in range(40)]
    assert replytree.format_paths(tree.limit(0)).count() == 0


def test_reply_trees_with_cycles_repeats_and_nulls(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "fine", 0.0), (1, 2, 1, "assistant", "fine", 0.0), (1, 10, 12, "user", "c", 0.0), (1, 11, 10, "user", "c", 0.0), (1, 12, 11, "user", "c", 0.0),
        (1, 13, 12, "user", "hangs", 0.0), (1, 14, 13, "user", "hangs", 0.0), (2, 1, 1, "user", "own parent", 0.0), (3, 1, 77, "user", "orphan", None), (None, None, None, None, None, None),
    ]
    tree = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double").withColumn("depth", F.lit("clash"))
    got = {r.tree_id: replytree.parse(r.formatted) for r in replytree.format_paths(tree).collect()}
    assert got == {1: [("user", "root"), ("assistant", "fine")], 3: [("user", "orphan")], -(2**63): [("none", "")]}
    chain = spark.range(300).select(F.lit(5).cast("long").alias("tree_id"), F.col("id").alias("msg_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"), F.lit("x").alias("text"), F.lit(0.0).alias("score"))
    assert len(replytree.parse(replytree.format_paths(chain).first().formatted)) == 300


def test_query_of_reply_trees_against_brute_force(spark, tmp_path):
    from lexiforge.llm import queries

    rng = random.Random(3)
    said = ["plain", "", None, "[INST] x [/INST]", "</s><s>", "<\\s>", "<<user>>", "emoji 🙂 é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(said)) for c in range(12) for t in range(rng.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        loss = "".join(x for role, x in turns if role == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.QUERIES["op10_reply_trees"](spark, str(tmp_path)).collect()}
    assert got == want


def test_cross_parsing_of_very_long_words_and_texts(spark):
    rng = random.Random(5)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    trained = crossparse.train(spark.createDataFrame([(" ".join(make(a, 5) for _ in range(40)), lang) for a, lang in (("abcde", "x"), ("defgh", "y")) for _ in range(9)], "text string, lang string"))
    rows = [(0, make("abcde", 3_000_000)), (1, " ".join(make("defgh", 5) for _ in range(300_000)))]
    assert {r.doc_id: r.lang_pred for r in crossparse.identify(spark.createDataFrame(rows, "doc_id long, text string"), trained).collect()} == {0: "x", 1: "y"}
    assert crossparse.shares(["a" * 50, "b" * 3, "c" * 50], 40) == ["bbb", "a" * 17, "c" * 17]


def test_crc_of_ids_is_little_endian(ids):
    assert zlib.crc32(ids[4].tobytes()) == zlib.crc32((1).to_bytes(4, "little")) and math.isfinite(len(ids))


def test_query_of_near_duplicates_against_brute_force(spark):
    import os

    from lexiforge.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(zip(w, w[1:], strict=False)) or frozenset([tuple(w)] if w else [])
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in texts:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = queries.QUERIES["op6_setsketch"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), root[i], root[i] == i) for i in texts}
    assert sum(root[i] != i for i in texts) > 5
