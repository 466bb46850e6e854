"""Odd tables for every operator, and queries and figures against brute force."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import castore, crossparse, decontam, editcount, histsort, lpf, packing, quality, queries, setsketch, wordcodes
from lexiforge.llm.common import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use for their own columns.
CLASHES = (
    "kept", "reason", "n_words", "shard", "slot", "size", "law", "component_id", "start", "length", "sequence_id", "ids", "root", "lang_pred", "score", "n_tokens", "tree", "leaf_ends",
    "item_id", "kind", "id", "wh", "tid", "th", "part", "chunks", "address", "b", "comp", "read", "__text", "__row", "__h", "__th", "__id", "a.b",
)


def _odd_rows():
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("aeioubcdst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    long, plain = say(60_000), say(150)
    word = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    return [
        (0, plain, "en", "s", 1), (0, plain, "en", "s", 1), (1, plain, None, None, None), (1, "other text of this id", "en", "s", 2), (None, plain, "en", "s", 3), (None, None, None, None, None), (2, None, "en", "s", 0),
        (3, "", "de", "s", 0), (4, " \n\t ", "de", "s", 4), (5, long, "en", "s", 5), (6, word, "de", "s", 6), (7, say(30) + " " + word[:500] + "\0 é 你好 🙂", None, "s", 7),
    ]


@pytest.fixture(scope="module")
def rows():
    return _odd_rows()


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def _ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def _multiset(pairs):
    return collections.Counter(pairs)


def test_quality_of_odd_rows(odd, rows):
    got = quality.fertility(odd).collect()
    assert _multiset((r.doc_id, r.n_words) for r in got) == _multiset((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    assert all(r.wh == "clash" and r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


def test_packing_of_odd_rows(odd, rows, tokenizer):
    texts = collections.defaultdict(list)
    got = packing.pack(odd, block_sequences=2).collect()
    at, pieces = collections.defaultdict(int), []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        pieces.append((r.doc_id, r.start, r.ids))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in at.values())
    for i, t, *_ in rows:
        texts[i].append(_ids(tokenizer, t))
    for i, want in texts.items():
        have = _multiset((s, x) for d, s, x in pieces if d == i)
        assert sum(len(x) * n for (_, x), n in have.items()) == sum(map(len, want))
        for ids in want:
            if len(want) == 1:
                assert b"".join(x for _, x in sorted(have)) == ids


def test_store_of_odd_rows(spark, odd, rows, tokenizer):
    got = castore.read_store(spark, castore.new_store(odd)).collect()
    assert _multiset((r.doc_id, bytes(r.ids)) for r in got) == _multiset((i, _ids(tokenizer, t)) for i, t, *_ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_sharding_of_odd_rows(odd, rows):
    got = histsort.histogram_sort(odd, "doc_id", shards=4).collect()
    want = _multiset((i, len((t or "").encode()) + 8) for i, t, *_ in rows)
    assert _multiset((r.doc_id, r["size"]) for r in got) == want and all(r.wh == "clash" for r in got)
    for s in range(4):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))


def test_near_duplicates_of_odd_rows(odd, rows):
    got = setsketch.near_duplicates(odd, k=2).collect()
    plain = [(r.doc_id, r.component_id) for r in got if r.n_shingles == len(set(zip(rows[0][1].split(), rows[0][1].split()[1:], strict=False)))]
    assert len(got) == len(rows) and _multiset(plain) == _multiset([(0, 0), (0, 0), (1, 0), (None, 0)])
    assert all(r.component_id == r.doc_id for r in got if r.doc_id in (2, 3, 4, 5, 6, 7)) and {r.n_shingles for r in got if r.doc_id in (2, 3, 4)} == {0}


def test_repeats_of_odd_rows(odd, rows):
    got = {bytes(r.tid): r for r in lpf.judge_texts(odd, length=100).collect()}
    for t in {t or "" for _, t, *_ in rows}:
        r, n = got[hashlib.md5(t.encode()).digest()], len(t.encode())
        assert r.n_bytes == n and (r.n_removed == n if t == rows[0][1] else r.n_removed in (0, 500) if len(t) > 500 else r.n_removed == 0)
    cut = lpf.remove_repeats(odd, length=100, keep="first").collect()
    assert len(cut) == len(rows) and all(r.wh == "clash" for r in cut)
    assert sum(r.text == rows[0][1] for r in cut) == 1


def test_leaks_of_odd_rows(spark, odd, rows):
    item = " ".join(rows[9][1].split()[100:140])
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, rows[10][1]), (5, "tiny")], "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {(r.doc_id, r.item_id, r.kind) for r in decontam.leaks(odd, bench).collect()}
    assert got == {(5, 1, "literal"), (5, None, "literal")}


def test_languages_of_odd_rows(spark, odd, rows):
    trained = crossparse.train(odd)
    assert [label for label, *_ in trained] == ["de", "en"]
    got = crossparse.identify(odd, trained).collect()
    assert len(got) == len(rows) and all(r.lang_pred == "und" and r.score == 0 for r in got if not (r.text or "").strip())
    assert {r.lang_pred for r in got if r.doc_id == 5} == {"en"} and {r.lang_pred for r in got if r.doc_id == 6} == {"de"} and all(r.wh == "clash" for r in got)
    assert crossparse.train(odd.limit(0)) == [] and crossparse.identify(odd.limit(0), trained).count() == 0


def test_edits_of_odd_rows(odd, rows, tokenizer):
    kinds = "array<struct<at int, cut int, put string>>"
    edits = F.expr("array(struct(3 as at, 2 as cut, ' mended ' as put), struct(cast(null as int) as at, cast(null as int) as cut, cast(null as string) as put), struct(50 as at, 1000000 as cut, '' as put))")
    trees = editcount.build_trees(odd).withColumn("edits", F.when(F.col("doc_id") == 1, F.lit(None)).otherwise(edits).cast(kinds))
    got = editcount.apply_edits(trees).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        assert r.edited_text == (t if r.doc_id == 1 else t[:3] + " mended " + t[5:50])
        assert r.n_tokens_after == len(tokenizer.encode(r.edited_text, add_special_tokens=False).ids)
    assert editcount.apply_edits(trees.limit(0)).count() == 0


def test_leaves_keep_their_size_over_many_edits(tokenizer):
    memo = wordcodes.BpeWords(vocabulary_path("word_bpe_49k.json"))
    rng = random.Random(1)
    bits = ["word", "a", " ", "  ", "\n", "\n\n", "\t", ".", "don't", "é", "12", "'s", " the", "X", " "]
    puts = ["", " ", "\n", "new", " and so on", ".", "'s", "\n\n  x", " ".join(["many"] * 40)]
    for _ in range(40):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 400)))
        ((ends, counts),) = editcount.leaves_of(memo, [text.encode()], 8)
        ends, tree = ends.astype(np.int32), editcount.build_tree(counts)
        for _ in range(8):
            places = [rng.choice([rng.randint(0, len(text) + 3), int(rng.choice(ends))]) for _ in range(rng.randint(1, 4))]
            done = editcount.Edited(text, ends, tree, [{"at": p, "cut": rng.choice([0, 0, 1, 4, 30, 200]), "put": rng.choice(puts)} for p in places])
            spans = [x[2].encode() for x in done.spans]
            done.settle(editcount.leaves_of(memo, spans, 8) if spans else [])
            text, ends, tree = done.text, done.ends, done.tree
            assert int(tree[1]) == len(tokenizer.encode(text, add_special_tokens=False).ids) and (ends[-1] if len(ends) else 0) == len(text)
            assert all(len(WORD.findall(text[a:b])) <= 16 for a, b in itertools.pairwise([0, *ends.tolist()]))


def test_fertility_figures_against_the_libraries(spark):
    import public_tokenizers
    import sentencepiece

    rng = random.Random(6)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))
    texts = [say("etaoinshrdlu", 80), say("etaoin", 30), say("абвгдежз", 60), say("你好世界人民", 40), say("0123456789", 50), say("qxzj#@~^", 70), "the " * 60, say("αβγδε", 25), "🙂🙃 " * 40, "", "one two", say("etaoin", 25) + " é 12 don't"]
    langs = [rng.choice(["en", "fr", None, "xx"]) for _ in texts]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.fertility(docs).collect()}
    piece = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rank = wordcodes.RankWords(vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).model
    seen = set()
    for i, t in enumerate(texts):
        words, r = WORD.findall(t), got[i]
        ids = [x for w in words for x in piece.encode(w)]
        n, n_2, chars = len(ids), sum(len(rank.encode_ordinary(" " + w)) for w in words), sum(map(len, words))
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())
        share = sum(piece.is_byte(x) for x in ids) / max(n, 1)
        assert (r.n_tokens, r.word_chars) == (n, chars)
        assert r.chars_per_token == pytest.approx(chars / max(n, 1)) and r.chars_per_token_2 == pytest.approx(chars / max(n_2, 1))
        assert r.byte_share == pytest.approx(share) and r.entropy_bits == pytest.approx(entropy, abs=1e-9)
        band = quality.LANGUAGE_BANDS.get(langs[i]) or quality.SCRIPT_BANDS[r.script]
        inside = band.chars_per_token[0] <= chars / max(n, 1) <= band.chars_per_token[1] and band.chars_per_token_2[0] <= chars / max(n_2, 1) <= band.chars_per_token_2[1]
        assert r.kept == (not r.base_failed and inside and share <= band.byte_share and not (n >= band.entropy_from and entropy < band.entropy_bits))
        seen.add(r.kept)
    assert seen == {True, False}


# -- templates by definition -------------------------------------------------


def _read(text):
    """Tokens as (surface, type or None, ends a sentence)."""
    edge = "\"'`“”‘’«»„()[]{}<>.,;:!?…*#&$|_-–—"
    out = []
    for word in WORD.findall(text or ""):
        core, ends = word.strip(edge), word.rstrip("\"'”’»)]*_")[-1:] in tuple(".!?:…")
        if core[:1].isdigit() and word[0] in "$€£":
            core = word[0] + core
        if core[-1:].isdigit() and core + "%" in word:
            core += "%"
        glued = re.fullmatch(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_/]+|%|°[cCfF]?)", core)
        if not core:
            continue
        if re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/\-]*", core):
            parts = [(core, "number")]
        elif glued and glued[2].lower() in decontam.UNITS:
            parts = [(glued[1], "number"), (glued[2], "unit")]
        elif core.lower() in decontam.UNITS:
            parts = [(core, "unit")]
        else:
            capital = core[0].isupper() and (len(core) == 1 or core[1:] != core[1:].upper())
            parts = [(core, "name" if capital else None)]
        out += [(x.lower(), kind, ends and k == len(parts) - 1) for k, (x, kind) in enumerate(parts)]
    return out


def _forms(text):
    """The literal tokens and those of both templates: lists of (token, slot value or None)."""
    read = _read(text)
    forms = {"literal": [(x, None) for x, _, _ in read]}
    for form in ("template", "names"):
        out, last = [], None
        for k, (x, kind, _) in enumerate(read):
            opens = k == 0 or read[k - 1][2]
            slot = kind if kind == "number" or kind == "unit" and k and read[k - 1][1] == "number" or kind == "name" and not opens else None
            alone = form == "names" and kind == "name" and opens
            slot = "name" if alone else slot
            if slot and slot == last and not alone:
                out[-1] = (out[-1][0], (*out[-1][1], x))
            else:
                out.append(("<" + slot + ">", (x,)) if slot else (x, None))
            last = None if alone else slot
        forms[form] = out
    return forms


def _leaks(docs, items):
    places = collections.defaultdict(list)
    lengths = {}
    for item, text in items.items():
        for form, tokens in _forms(text).items():
            size = min(8, len(tokens))
            lengths[item, form] = len(tokens) - size + 1
            for p in range(len(tokens) - size + 1 if size >= 5 else 0):
                places[form, tuple(t for t, _ in tokens[p : p + size])].append((item, p, tokens))
    best = {}
    for doc, text in docs.items():
        lines = collections.defaultdict(lambda: (set(), set(), set()))
        for form, tokens in _forms(text).items():
            for size, p in itertools.product(range(5, 9), range(len(tokens))):
                for item, q, theirs in places.get((form, tuple(t for t, _ in tokens[p : p + size])), ()) if p + size <= len(tokens) else ():
                    at, words, bound = lines[item, form, p - q]
                    at.add(q)
                    words.update(k for k in range(q, q + size) if theirs[k][1] is None)
                    bound.update((tuple(sorted(theirs[q + k][1])), tuple(sorted(tokens[p + k][1]))) for k in range(size) if theirs[q + k][1] is not None)
        for (item, form, _), (at, words, bound) in lines.items():
            share, slots = len(at) / lengths[item, form], len({a for a, _ in bound})
            if form == "literal":
                leak = share >= 0.3 or len(at) >= 6
            else:
                leak = share >= 0.5 and (len(words) >= 4 or share == 1 and words) and len(bound) == slots
            if leak:
                kind = "literal" if form == "literal" else "template"
                best[doc, item] = max(best.get((doc, item), ()), (share, len(at), kind == "literal", kind, slots))
    return {key: (kind, n, round(share, 9), slots) for key, (share, n, _, kind, slots) in best.items()}


def test_query_of_templates_against_brute_force(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    rng = random.Random(12)
    # the same table with re-parameterised, half consistent and cut items between its texts
    for n in range(40):
        item, named = rng.choice(sorted(items)), {}
        words = f"Then Anna took {n + 3} kg of it to Rome. {items[item]} So {n} of them left at 5.".split()
        slots = [rng.randrange(len(words)) for _ in range(3)]
        items[10_000 + n] = " ".join(f"Item{k}" if k in slots else w for k, w in enumerate(words))
        change = lambda w, named=named: named.setdefault(w, str(rng.randint(1, 99))) if w.isdigit() else named.setdefault(w, rng.choice(["Omar", "Lena", "Ivo"])) if w[0].isupper() and rng.random() < 0.7 else w
        docs[10_000 + n] = "Well, " + " ".join(change(w) for w in items[10_000 + n].split()[rng.randint(0, 8) :]) + " " + (docs[rng.choice(sorted(docs))] or "")[:500]
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.kind, r.n_windows, round(r.coverage, 9), r.n_slots) for r in queries.QUERIES["op3_templates"](spark, str(tmp_path)).collect()}
    want = _leaks(docs, items)
    assert got == want and {k for k, *_ in want.values()} == {"literal", "template"}
