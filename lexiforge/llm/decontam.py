"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items are read as tokens.  Numbers, units after a number
and names (capitalised words inside a sentence) become typed placeholders, runs
of one type a single placeholder, whose surface is kept as the slot's value.
Whether a capital that opens a sentence is a name cannot be told, so there are
two templates: in one it stays a word, in the other (``names``) it is a name of
its own.  Windows of tokens are hashed as they stand and as either template.
Windows of documents meet those of the benchmark in a hash join; matches of a document
and an item on one diagonal (document position minus item position) form an
alignment.

* A literal alignment is a leak if it covers enough of the item or is long.
* A template alignment is a leak if it covers half of the item's windows, with
  or without slots, spells enough words (half a window; or all of the item,
  with one word at least) and its slots are consistent: each value of the item
  maps to one value of the document, wherever it occurs.  That catches re-parameterised questions and leaves
  texts alone that merely share a frame.

Defined results: null and empty texts match nothing; items of fewer than
``least`` tokens are not searched; items of slots only are searched literally;
repeated documents (equal id) are one
document, and so are all of null id; very long texts are searched whole; of several ways in which a
document leaks an item the best covered is told, ties going to more windows and
then to the literal one; an empty table on either side gives an empty result;
the columns used are ids and texts, others, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import wordcodes
from lexiforge.llm.common import blocks, stage

#: Units of measure that may follow a number (fixed values).
UNITS = frozenset(
    "% ° °c °f mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec secs min mins h hr hrs hour hours day days week weeks month months "
    "year years hz khz mhz ghz b kb mb gb tb w kw kwh v a j kj cal kcal pa kpa bar mph kmh km/h m/s meter meters metre metres mile miles inch inches "
    "foot feet gram grams kilogram kilograms liter liters litre litres minute minutes second seconds dollar dollars euro euros cent cents usd eur".split()
)
_NUM, _UNIT, _NAME, _END = 1, 2, 4, 8
_EDGE = "\"'`“”‘’«»„()[]{}<>.,;:!?…*#&$|_-–—"
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/\-]*")
_GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_/]+|%|°[cCfF]?)")


class CanonicalWords(wordcodes.WordMemo):
    """Each word as zero or more tokens of three numbers: hash (two halves) and flags."""

    def encode_words(self, words):
        return [self._tokens(w.decode()) for w in words]

    @staticmethod
    def _tokens(word: str) -> list[int]:
        core = word.strip(_EDGE)
        end = _END if word.rstrip("\"'”’»)]*_").endswith((".", "!", "?", ":", "…")) else 0
        if word.startswith(("$", "€", "£")) and core[:1].isdigit():
            core = word[0] + core
        if core + "%" in word and core[-1:].isdigit():
            core += "%"
        if not core:
            return []
        if _NUMBER.fullmatch(core):
            parts = [(core, _NUM)]
        elif (m := _GLUED.fullmatch(core)) and m[2].lower() in UNITS:
            parts = [(m[1], _NUM), (m[2], _UNIT)]
        elif core.lower() in UNITS:
            parts = [(core, _UNIT)]
        else:
            parts = [(core, _NAME if core[0].isupper() and core[1:] != core[1:].upper() or len(core) == 1 and core.isupper() else 0)]
        out = []
        for i, (x, flag) in enumerate(parts):
            h = xxhash.xxh64_intdigest(x.lower().encode())
            out += [h & 0xFFFFFFFF, h >> 32, flag | (end if i == len(parts) - 1 else 0)]
        return out


def _placeholder(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name.encode(), seed=3))


_HOLD = {_NUM: _placeholder("number"), _UNIT: _placeholder("unit"), _NAME: _placeholder("name")}


def streams(memo: CanonicalWords, texts: list[bytes]):
    """Literal tokens and tokens of both templates of all texts.

    Gives three tuples (token hash, placeholder kind, value, edges per text).
    """
    flat, edges = memo.encode(texts)
    flat, edges = flat.reshape(-1, 3), edges // 3
    surface = flat[:, 0].astype(np.uint64) | flat[:, 1].astype(np.uint64) << np.uint64(32)
    flags, n = flat[:, 2], len(flat)
    first = np.zeros(n, bool)
    first[edges[:-1][edges[:-1] < n]] = True
    before = np.concatenate([[0], flags[:-1]])
    before[first] = _END
    kind = np.where(flags & _NUM, _NUM, 0)
    kind[(flags & _UNIT > 0) & (before & _NUM > 0) & ~first] = _UNIT
    kind[(flags & _NAME > 0) & (before & _END == 0)] = _NAME
    opens = (flags & _NAME > 0) & (before & _END > 0)

    def held(kind, alone):
        follows = np.concatenate([[False], (kind[1:] == kind[:-1]) & (kind[1:] > 0) & ~alone[1:] & ~alone[:-1]]) & ~first
        heads = np.flatnonzero(~follows)
        token = surface.copy()
        for k, h in _HOLD.items():
            token[kind == k] = h
        value = np.add.reduceat(surface, heads) if n else surface
        return token[heads], kind[heads], value, np.searchsorted(heads, edges)

    return (surface, np.zeros(n, np.int64), surface, edges), held(kind, np.zeros(n, bool)), held(np.where(opens, _NAME, kind), opens)


def windows(stream, size: int):
    """Hash, start and text number of every window of ``size`` tokens within one text."""
    token, _, _, edges = stream
    n = len(token)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = token * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * wordcodes.powers("r", n))])
    h = (total[size:] - total[:-size]) * wordcodes.powers("i", n)[: n - size + 1]
    h ^= h >> np.uint64(31)
    docs = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    ok = docs[: n - size + 1] == docs[size - 1 :]
    at = np.flatnonzero(ok)
    return h[at] + np.uint64(size), at, docs[at]


KINDS = ("literal", "template", "names")
WINDOW_FIELDS = "wh long, kind string, size int, pos int, n_tokens int, slots array<long>, words array<int>"


def window_rows(memo: CanonicalWords, texts: list[bytes], sizes: list[int], full: int, own_size: bool, wanted: np.ndarray | None):
    """Windows of a block of texts: columns of ``WINDOW_FIELDS`` and each row's text number.

    own_size: a text shorter than ``full`` gives one window, of its own length.
    wanted: sorted hashes; other windows are left out.
    words: positions of the tokens that are no slots, given with ``own_size`` only.
    """
    out = {"doc": [], "wh": [], "kind": [], "size": [], "pos": [], "n_tokens": [], "slots": [], "words": []}
    for name, stream in zip(KINDS, streams(memo, texts), strict=True):
        _, kind, value, edges = stream
        lengths = np.diff(edges)
        for size in sizes:
            h, at, doc = windows(stream, size)
            keep = np.ones(len(h), bool)
            if own_size:
                keep &= (lengths[doc] == size) | (size == full)
            if wanted is not None:
                spot = np.searchsorted(wanted, h)
                spot[spot == len(wanted)] = 0
                keep &= wanted[spot] == h if len(wanted) else False
            h, at, doc = h[keep], at[keep], doc[keep]
            out["doc"] += doc.tolist()
            out["wh"] += h.view(np.int64).tolist()
            out["kind"] += [name] * len(h)
            out["size"] += [size] * len(h)
            out["pos"] += (at - edges[doc]).tolist()
            out["n_tokens"] += lengths[doc].tolist()
            out["words"] += [(np.flatnonzero(kind[a : a + size] == 0) + (a - e)).tolist() if own_size else [] for a, e in zip(at.tolist(), edges[doc].tolist(), strict=True)]
            out["slots"] += [value[a : a + size][kind[a : a + size] > 0].view(np.int64).tolist() for a in at.tolist()]
    return out


def _windowed(df: DataFrame, key: str, text: str, sizes: list[int], full: int, own_size: bool, wanted: np.ndarray | None) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        (memo,) = wordcodes.held((CanonicalWords,))
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for s, e in blocks([len(t) for t in texts], 1_000_000):
                got = window_rows(memo, texts[s:e], sizes, full, own_size, wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[s + i] for i in got["doc"]], pa.int64()), pa.array(got["wh"], pa.int64()), pa.array(got["kind"], pa.string()),
                        pa.array(got["size"], pa.int32()), pa.array(got["pos"], pa.int32()), pa.array(got["n_tokens"], pa.int32()), pa.array(got["slots"], pa.list_(pa.int64())),
                        pa.array(got["words"], pa.list_(pa.int32())),
                    ],
                    names=["id", "wh", "kind", "size", "pos", "n_tokens", "slots", "words"],
                )

    source = df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string").cast("binary"))
    return source.mapInArrow(run, f"id long, {WINDOW_FIELDS}")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 8,
    least: int = 5,
    literal_coverage: float = 0.3,
    literal_windows: int = 6,
    template_coverage: float = 0.5,
    most_held: int = 1_000_000,
) -> DataFrame:
    """One row (doc_id, item_id, kind, n_windows, coverage, n_slots) per document and item it leaks.

    While the benchmark has at most ``most_held`` windows, their hashes go to
    the executors, which emit matching windows only; a larger benchmark meets
    all windows in a shuffled join.  The result is the same.
    """
    sizes = list(range(least, window + 1))
    items = stage(_windowed(benchmark, item_id, text, sizes, window, True, None), "items")
    count = items.count()
    held = count <= most_held
    wanted = np.unique(np.array([r[0] for r in items.select("wh").distinct().collect()], np.int64).view(np.uint64)) if held else None
    used = sorted(r[0] for r in items.select("size").distinct().collect())
    if not used:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string, n_windows long, coverage double, n_slots int")
    found = _windowed(docs, doc_id, text, used, window, False, wanted)
    right = items.select("wh", "kind", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("words").alias("item_words"), "size", F.col("n_tokens").alias("item_tokens"))
    pairs = found.drop("size", "n_tokens", "words").join(F.broadcast(right) if held else right, ["wh", "kind"])
    aligned = pairs.groupBy(F.col("id").alias("doc_id"), "item_id", "kind", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.count_distinct("item_pos").alias("n_windows"),
        F.max(F.col("item_tokens") - F.col("size") + 1).alias("of_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("item_words")))).alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("bound"),
    )
    judged = aligned.select(
        "doc_id", "item_id", "kind", "n_windows", "n_words", (F.col("n_windows") / F.col("of_windows")).alias("coverage"),
        F.size(F.array_distinct("bound.item_slots")).alias("n_slots"), (F.size("bound") == F.size(F.array_distinct("bound.item_slots"))).alias("consistent"),
    )
    spelt = (F.col("n_words") >= window // 2) | (F.col("coverage") == 1) & (F.col("n_words") > 0)
    leak = F.when(F.col("kind") == "literal", (F.col("coverage") >= literal_coverage) | (F.col("n_windows") >= literal_windows)).otherwise((F.col("coverage") >= template_coverage) & spelt & F.col("consistent"))
    kind = F.when(F.col("kind") == "literal", "literal").otherwise("template").alias("kind")
    best = F.max(F.struct("coverage", "n_windows", F.col("kind") == "literal", kind, "n_slots")).alias("best")
    return judged.where(leak).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.kind", "best.n_windows", "best.coverage", "best.n_slots")
