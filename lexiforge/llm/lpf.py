"""Exact removal of repeated passages with suffix order and longest previous factors.

A byte goes if a string of ``length`` bytes that covers it also starts
elsewhere, in the same text or another.  Two ways to judge: ``keep="none"``
removes every copy, ``keep="first"`` only those with an earlier one (texts by
least id, then place).

How it scales:

1. Texts are taken once each (pre-aggregated); a text that has copies is a
   repeat of itself.
2. Every ``length``-byte window is filed under the least hash of the short
   grams inside it.  Equal windows have equal files, so only files met twice go
   on, and only as much text as lies around them.
3. Windows filed together in one place form a run; equal runs are one class,
   however many copies there are.
4. The classes of a few files at a time are put into suffix order (prefix
   doubling, refined only where suffixes are still equal), and the longest
   previous factor of every window is taken from the previous and the next
   smaller position in that order, up to ``length`` bytes.  A window goes if its
   factor has all of them; with ``keep="none"`` so does the earlier match.
5. A file with very many classes (a common passage in ever new surroundings)
   would fill one task; its windows are met by 128-bit hashes instead.

Texts are told apart by 128 bits, runs by their file and content (128 bits).

Defined results: null texts count as empty; texts shorter than ``length`` lose
nothing to others; very long texts are read in overlapping pieces; copies of
one id and text are one place, and ties of an id go to the lesser digest of the
text; a null id comes before all others; an empty table gives an empty result;
other columns, whatever their names, are carried by ``remove_repeats``.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import wordcodes
from lexiforge.llm.common import Scratch, blocks, columns_of, own_prefix, shuffles_dropped

_LOWEST = -(2**63)
_PLACE_BITS = 24
_PIECE = 1_000_000
_SORTED = 150_000


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each place on (polynomial over random byte values)."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(wordcodes._VALUES[buf] * wordcodes.powers("r", n), out=total[1:])
    h = (total[k:] - total[:-k]) * wordcodes.powers("i", n)[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def window_files(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least gram among the ``width`` grams from each place on (ties: the first)."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= width:
        v = np.minimum(v[:-m], v[m:])
        m *= 2
    if rest := width - m:
        v = np.minimum(v[:-rest], v[rest:])
    return (v & low).astype(np.int64)


def runs_of(texts: list[bytes], length: int, gram: int):
    """Runs of window starts filed under one gram: (text, start, windows, file hash, content hash)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    if len(buf) < length:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    h = gram_hashes(buf, gram)
    file = window_files(h, length - gram + 1)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(file)]
    valid = np.arange(len(file)) + length <= ends[text]
    fresh = np.ones(len(file), bool)
    fresh[1:] = (file[1:] != file[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh & valid)
    # a run ends at the next fresh place or with its text's last window
    stop = np.minimum(np.append(np.flatnonzero(fresh), len(file))[np.searchsorted(np.flatnonzero(fresh), at) + 1], ends[text[at]] - length + 1)
    data = memoryview(buf)
    content = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(at.tolist(), (stop + length - 1).tolist(), strict=True)), np.uint64, len(at))
    return text[at], at - (ends - sizes)[text[at]], stop - at, h[file[at]], content


def suffix_ranks(buf: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(depth, rank of every suffix by its first ``depth`` bytes) for depths 8, 16, ... up to ``length``.

    Equal ranks mean equal bytes; behind the end stand zeros.  A suffix already unlike all others keeps its
    rank, so only the rest is sorted again.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    rank, live, open_, depth, out = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.ones(n, bool), 8, []
    while True:
        order = np.argsort(key)
        sorted_key, live = key[order], live[order]
        place = np.arange(len(live), dtype=np.int32)
        fresh = np.ones(len(live), bool)
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=fresh[1:])
        old = rank[live]
        base = np.ones(len(live), bool)
        np.not_equal(old[1:], old[:-1], out=base[1:])
        # a class begins as far behind its old class's beginning as there are members before it
        rank[live] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(base, place, 0))
        out.append((depth, rank.copy()))
        if 2 * depth > length:
            return out
        open_[live[fresh & np.append(fresh[1:], True)]] = False
        live = np.flatnonzero(open_).astype(np.int32)
        key = rank[live] * np.int64(n + 1) + rank[np.minimum(live + np.int32(depth), n - 1)]
        depth *= 2


def common_prefix(buf: np.ndarray, ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at i and j have in common, up to ``length``; no suffix comes nearer to the end than twice that."""
    same = np.zeros(len(i), np.int32)
    for depth, rank in reversed(ranks):
        same += (rank[i + same] == rank[j + same]) * np.int32(depth)
    live = np.flatnonzero(same < length)
    for _ in range(7):  # what is left is shorter than 8 bytes
        live = live[buf[i[live] + same[live]] == buf[j[live] + same[live]]]
        same[live] += 1
    return np.minimum(same, length)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1 (all values differ)."""
    near = np.arange(-1, len(values) - 1, dtype=np.int32)
    live = np.flatnonzero((near >= 0) & (values[near] > values))
    while len(live):  # all values between near[i] and i are larger than values[i]
        near[live] = near[near[live]]
        at = near[live]
        live = live[(at >= 0) & (values[at] > values[live])]
    return near


def longest_previous_factors(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each suffix with an earlier one, up to ``length`` bytes, and which that is (-1: none).

    starts: suffixes in the order of their places; each has ``length`` bytes.
    """
    buf, starts = np.concatenate([buf, np.zeros(2 * length, np.uint8)]), starts.astype(np.int32)
    ranks = suffix_ranks(buf, length)
    depth, rank = ranks[-1]
    key = rank[starts] * np.int64(len(buf) + 1) + rank[starts + np.int32(length - depth)]
    order = np.argsort(key, kind="stable").astype(np.int32)  # suffix order; equal suffixes by place
    best, source = np.zeros(len(starts), np.int32), np.full(len(starts), -1, np.int32)
    for listed in (order, order[::-1]):  # previous, then next smaller position
        near = nearest_smaller(listed)
        has = np.flatnonzero(near >= 0)
        own, other = listed[has], listed[near[has]]
        n = common_prefix(buf, ranks, starts[own], starts[other], length)
        more = n > best[own]
        best[own[more]], source[own[more]] = n[more], other[more]
    return best, source


def repeated_windows(data: list[bytes], windows: np.ndarray, length: int, first: bool) -> list[np.ndarray]:
    """For each run, in the order of places, its windows that also start elsewhere (first: earlier)."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    buf = np.frombuffer(b"".join(data), np.uint8)
    run = np.repeat(np.arange(len(data)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    factor, source = longest_previous_factors(buf, (np.cumsum(sizes) - sizes)[run] + inner, length)
    hit = factor == length
    if not first:
        hit[source[hit]] = True
    return [np.flatnonzero(x) for x in np.split(hit, np.cumsum(windows)[:-1])]


def _as_ranges(at: np.ndarray) -> list[dict]:
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > 1)
    low, high = at[np.concatenate([[0], gaps + 1])], at[np.concatenate([gaps, [len(at) - 1]])] + 1
    return [{"low": int(a), "high": int(b)} for a, b in zip(low, high, strict=True)]


def _pieces(ids: list, orders: list, texts: list, length: int):
    """Texts as (tid, order, first byte, bytes); very long ones in overlapping pieces."""
    for tid, order, t in zip(ids, orders, texts, strict=True):
        for c in range(0, max(1, len(t) - length + 1), _PIECE):
            yield tid, order, c, t if len(t) <= _PIECE else t[c : c + _PIECE + length - 1]


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        wordcodes.held()
        for batch in batches:
            pieces = list(_pieces(*(batch.column(i).to_pylist() for i in range(3)), length))
            for s, e in blocks([len(p[3]) for p in pieces], _PIECE):
                own = pieces[s:e]
                text, start, windows, file, content = runs_of([p[3] for p in own], length, gram)
                order, base = (np.array([p[i] for p in own], np.int64)[text] for i in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in own], pa.binary()).take(pa.array(text)), pa.array(order), pa.array((base + start).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(file.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["tid", "ord", "start", "windows", "file", "content"],
                )
        wordcodes.tidy()

    return texts.where(F.octet_length("text") >= length).select("tid", "ord", "text").mapInArrow(run, "tid binary, ord long, start int, windows int, file long, content long")


def _with_bytes(runs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Runs with their bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for tid, order, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a["file"] for a in asked], pa.int64()), pa.array([a["content"] for a in asked], pa.int64()), pa.array([order] * len(asked), pa.int64()),
                        pa.array([tid] * len(asked), pa.binary()), pa.array([a["start"] for a in asked], pa.int32()), pa.array([a["windows"] for a in asked], pa.int32()),
                        pa.array([text[a["start"] : a["start"] + a["windows"] + length - 1] for a in asked], pa.binary()),
                    ],
                    names=["file", "content", "ord", "tid", "start", "windows", "data"],
                )

    asked = runs.groupBy("tid").agg(F.collect_list(F.struct("file", "content", "start", "windows")).alias("asked"))
    return texts.select("tid", "ord", "text").join(asked, "tid").select("tid", "ord", "text", "asked").mapInArrow(run, "file long, content long, ord long, tid binary, start int, windows int, data binary")


_FOUND = "file long, content long, ranges array<struct<low:int,high:int>>"


def _by_suffix_order(runs: DataFrame, texts: DataFrame, length: int, first: bool, tasks: int) -> DataFrame:
    import pandas as pd

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["file", "ord", "tid", "start"], kind="stable", ignore_index=True)
        file = pdf.file.to_numpy()
        heads = np.flatnonzero(np.append(True, file[1:] != file[:-1]))
        per_file = np.add.reduceat(pdf.data.map(len).to_numpy(), heads)
        ranges, stops = [None] * len(pdf), np.append(heads[1:], len(pdf))
        for s, e in blocks(per_file.tolist(), _SORTED):  # whole files, few enough for the processor's cache
            own = pdf.iloc[heads[s] : stops[e - 1]].sort_values(["ord", "tid", "start"], kind="stable")
            for i, h in zip(own.index, repeated_windows(list(own.data), own.windows.to_numpy(np.int64), length, first), strict=True):
                ranges[i] = _as_ranges(h)
        wordcodes.tidy()
        return pd.DataFrame({"file": pdf.file, "content": pdf.content, "ranges": ranges})

    dealt = _with_bytes(runs, texts, length).withColumn("task", F.pmod(F.xxhash64("file"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(lambda pdf: judge(pdf.drop(columns="task")), _FOUND)


def _by_window_hash(runs: DataFrame, texts: DataFrame, length: int, first: bool, scratch: Scratch) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for file, content, order, tid, start, windows, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                prints = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(windows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * windows, pa.int64()), pa.array([content] * windows, pa.int64()), pa.array([order] * windows, pa.int64()), pa.array([tid] * windows, pa.binary()),
                        pa.array(np.arange(start, start + windows, dtype=np.int32)), pa.array(np.arange(windows, dtype=np.int32)), pa.array(prints, pa.binary()),
                    ],
                    names=["file", "content", "ord", "tid", "at", "inner", "print"],
                )

    windows = scratch.put(_with_bytes(runs, texts, length).mapInArrow(run, "file long, content long, ord long, tid binary, at int, inner int, print binary"), "windows")
    place = F.struct("ord", "tid", "at")
    met = windows.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).where("n > 1")
    hit = windows.join(met, "print").where(place != F.col("least") if first else F.lit(True))
    listed = hit.groupBy("file", "content").agg(F.collect_list(F.struct(F.col("inner").alias("low"), (F.col("inner") + 1).alias("high"))).alias("ranges"))
    return listed.select("file", "content", "ranges")


def text_id(text: str) -> Column:
    """128-bit identity of a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))


def distinct_texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts once each, (tid, text, ord, copies), in a table bucketed by tid.

    Later joins on tid then leave the texts where they are.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(text_id(text).alias("tid"), body.alias("text"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LOWEST)).alias("id"))
    once = rows.groupBy("tid").agg(F.first("text").alias("text"), F.min("id").alias("ord"), F.count(F.lit(1)).alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        once.write.option("compression", "zstd").bucketBy(parts, "tid").sortBy("tid").format("parquet").saveAsTable(name)
    return spark.table(name)


def judge_texts(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, keep: str = "none", gram: int = 64, task_bytes: int = 1_000_000, most_classes: int = 3000, readable: bool = False
) -> DataFrame:
    """(tid, ord, copies, n_bytes, n_removed, n_spans, spans, kept) of every distinct text; tid is its ``text_id``.

    With ``keep="first"`` the figures hold for the first copy of a text.  kept
    is binary; ``readable`` gives a string less the halves of characters that a
    cut has left.
    """
    import pyarrow as pa

    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    first, gram = keep == "first", min(gram, length // 2)
    texts, scratch = distinct_texts(df, doc_id, text), Scratch(df.sparkSession)
    runs = scratch.put(_runs(texts, length, gram), "runs")
    # written first: a join of two plain exchanges is split where a file is hot
    files = scratch.put(runs.groupBy("file").agg(F.count(F.lit(1)).alias("n"), (F.min("content") == F.max("content")).alias("one")).where("n > 1").select("file", "one"), "files")
    met = scratch.put(runs.join(files, "file"), "met")
    scratch.drop("runs", "files")
    classes = scratch.put(met.groupBy("file", "content").agg(F.count(F.lit(1)).alias("n"), F.first("one").alias("one"), F.min(F.struct("ord", "tid", "start", "windows")).alias("least")), "classes")
    # a class with copies is known to repeat; as partners of others all classes of a mixed file are compared
    mixed = classes.where("not one").select("file", "content", "least.tid", "least.start", "least.windows")
    hot = mixed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_classes).select("file")
    hot = scratch.put(hot, "hot")
    some = not hot.isEmpty()
    usual = mixed.join(hot, "file", "left_anti") if some else mixed
    total = usual.agg(F.sum(F.col("windows") + length)).first()[0] or 0
    found = _by_suffix_order(usual, texts, length, first, max(1, int(total // task_bytes)))
    if some:
        found = found.unionByName(_by_window_hash(mixed.join(hot, "file", "left_semi"), texts, length, first, scratch))
    found = scratch.put(found.where(F.size("ranges") > 0), "found")
    # written too: the join with the runs, where one class may hold most rows, is then split as well
    verdicts = scratch.put(classes.select("file", "content", F.col("n").alias("copies_of_run"), "least").join(found, ["file", "content"], "left").where("copies_of_run > 1 or ranges is not null"), "verdicts")
    judged = met.join(verdicts, ["file", "content"])
    whole = ((F.col("tid") != F.col("least.tid")) | (F.col("start") != F.col("least.start"))) if first else F.col("copies_of_run") > 1
    ranges = F.when(whole, F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high")))).otherwise(F.col("ranges"))
    spans = judged.select("tid", "start", F.explode(ranges).alias("r")).select("tid", F.struct((F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high") - 1 + length).alias("high")).alias("span"))
    per_text = scratch.put(spans.groupBy("tid").agg(F.collect_list("span").alias("marks")), "marks")
    scratch.drop("met", "classes", "hot", "windows", "found", "verdicts")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for data, copies, marks in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                merged: list[list[int]] = []
                if copies > 1 and len(data) >= length and not first:
                    merged = [[0, len(data)]]
                else:
                    for low, high in sorted((m["low"], m["high"]) for m in marks or ()):
                        if merged and low <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], high)
                        else:
                            merged.append([low, high])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                left = kept.decode("utf-8", "ignore") if readable else kept
                for col, x in zip(out, (len(data), len(data) - len(kept), len(merged), [{"low": a, "high": b} for a, b in merged], left), strict=True):
                    col.append(x)
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.string() if readable else pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["tid", "ord", "copies", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return (
        texts.join(per_text, "tid", "left").select("tid", "ord", "copies", "text", "marks")
        .mapInArrow(cut, f"tid binary, ord long, copies long, n_bytes long, n_removed long, n_spans long, spans array<struct<low:int,high:int>>, kept {'string' if readable else 'binary'}")
    )


def word_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tid, digest): every text as two bytes a word (words in lower case, A-Z only; null: none)."""
    import pyarrow as pa

    def run(batches):
        wordcodes.held()
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for s, e in blocks([len(t) for t in texts], _PIECE):
                buf, edges = wordcodes.join_texts(texts[s:e])
                low = wordcodes._LOWER[buf]
                starts, ends = wordcodes.find_words(low)
                data = wordcodes.hash_spans(low, starts, ends).astype("<u2").tobytes()
                at = 2 * np.searchsorted(starts, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "tid", "digest"])
        wordcodes.tidy()

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_id(text).alias("tid"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tid binary, digest binary")


def repeated_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 51) -> DataFrame:
    """(doc_id, tid, n_passage_words) of every row: its words in passages of ``words`` words or more that stand elsewhere too.

    The same search as over bytes, over two bytes a word: a passage counts
    whatever its white space and case; a word that differs is taken for equal with
    probability 2**-16.
    """
    scratch = Scratch(df.sparkSession)
    digests = scratch.put(word_digests(df, doc_id, text), "digests")
    found = scratch.put(judge_texts(digests, "doc_id", "digest", 2 * words, "none", gram=12, task_bytes=600_000).select(F.col("tid").alias("digest_id"), F.ceil(F.col("n_removed") / 2).alias("n_passage_words")), "passages")
    rows = scratch.put(digests.select("doc_id", "tid", text_id("digest").alias("digest_id")), "rows")
    scratch.drop("digests")
    return rows.join(found, "digest_id").select("doc_id", "tid", "n_passage_words")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, keep: str = "first") -> DataFrame:
    """``df`` with its texts less the repeated passages; characters cut in two go as a whole.

    With ``keep="first"`` a later copy of a whole text loses all of it (none if
    shorter than ``length``).
    """
    p = own_prefix(df)
    judged = judge_texts(df, doc_id, text, length, keep, readable=True).select(F.col("tid").alias(f"{p}tid"), F.col("ord").alias(f"{p}ord"), F.col("kept").alias(f"{p}kept"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LOWEST))
    joined = df.withColumn(f"{p}tid", text_id(text)).join(judged, f"{p}tid")
    if keep == "first":
        later = F.when(F.octet_length(body) >= length, F.lit("")).otherwise(body)
        new = F.when(own == F.col(f"{p}ord"), F.col(f"{p}kept")).otherwise(later)
    else:
        new = F.col(f"{p}kept")
    return joined.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), new)).select(*columns_of(df))
