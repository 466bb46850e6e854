"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match
of what comes next; a text is parsed greedily into such phrases, and the
language that needs the fewest phrases per character wins.  Phrases do not
cross white space (a phrase may begin with the blank before a word), so the
phrases of a text are the sum over its words and each distinct word is parsed
once per worker; parsing walks all words of a block together, one character a
step.  A word of more than 64 characters is parsed in stretches of 64.

The automata come from a bounded sample: per language at most ``sample_rows``
distinct labelled texts, those of least hash, of each at most ``row_chars``
characters, and ``sample_chars`` characters in all, to which every sampled text
gives its share.

Defined results: null, empty and letterless texts are ``und`` with score 0; so
is every text when nothing is labelled; ties go to the language first in the
alphabet; repeated rows are judged alike; rows of null text or null language teach
nothing; an empty table gives an empty result; very long texts, and texts of one very
long word, are read whole; extra columns are carried along, one named like a
result column gives way to it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm import wordcodes
from lexiforge.llm.common import map_texts, stage

_STRETCH = 64
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def suffix_automaton(text: str) -> tuple[dict[str, int], np.ndarray]:
    """Letters' numbers (1, 2, ...) and the transition table (state x letter, -1: none)."""
    letters = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
    step, link, length, last = [{}], [-1], [0], 0
    for c in (letters[x] for x in text):
        cur, p = len(step), last
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((len(step), len(letters) + 1), -1, np.int32)
    for s, to in enumerate(step):
        for c, t in to.items():
            table[s, c] = t
    return letters, table


def count_phrases(letters: dict[str, int], table: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phrases of each word ``codes[start:end]`` (code points) in a greedy parse."""
    known = np.array(sorted(map(ord, letters)), np.int64)
    spot = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
    letter = np.where(known[spot] == codes, spot + 1, 0) if len(known) else np.zeros(len(codes), np.int64)
    order = np.argsort(starts - ends, kind="stable")  # long words first, so the live ones stay in front
    starts, sizes = starts[order], (ends - starts)[order]
    state, phrases = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    fresh = np.ones(len(starts), bool)
    live = len(starts)
    for i in range(int(sizes[0]) if live else 0):
        while live and sizes[live - 1] <= i:
            live -= 1
        c = letter[starts[:live] + i]
        to = table[state[:live], c]
        stuck = to < 0
        phrases[:live] += fresh[:live] | stuck & ~fresh[:live]
        again = table[0, c]
        state[:live] = np.where(stuck, np.maximum(again, 0), to)
        fresh[:live] = stuck & (again < 0)  # a character the language lacks is a phrase of its own
    out = np.empty(len(starts), np.int64)
    out[order] = phrases
    return out


class PhraseCounts(wordcodes.WordMemo):
    """Per word: its characters, then its phrases in every language."""

    def __init__(self, automata: list, capacity: int = wordcodes.CAPACITY):
        self.automata = automata
        super().__init__(capacity)

    def encode_words(self, words):
        parts = [" " + w.decode().lower() for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        stretches = -(-sizes // _STRETCH)
        first = np.cumsum(stretches) - stretches
        inner = np.arange(stretches.sum()) - np.repeat(first, stretches)
        begin = np.repeat(np.cumsum(sizes) - sizes, stretches) + inner * _STRETCH
        end = np.minimum(begin + _STRETCH, np.repeat(np.cumsum(sizes), stretches))
        return np.stack([sizes, *(np.add.reduceat(count_phrases(a, t, codes, begin, end), first) for a, t in self.automata)], axis=1).tolist()


def _has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode()))


def train(df: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = 200, sample_chars: int = 30_000, row_chars: int = 2000) -> list[tuple[str, dict, np.ndarray]]:
    """Automata of every label of ``df``: (label, letters, table), labels ascending."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    # copies of a text are one; its hash stands for it
    keys = stage(rows.select("lang", "h").distinct(), "sample-keys")
    sizes = keys.groupBy("lang").count()
    few = sizes.count() <= 10_000
    held = lambda df: F.broadcast(df) if few else df
    # few hashes pass the filter; only they are ranked, and all hashes of a label that it leaves short
    marked = keys.join(held(sizes), "lang").withColumn("near", F.pmod("h", F.lit(1_000_003)) <= F.lit(4.0 * sample_rows * 1_000_003) / F.col("count"))
    short = marked.groupBy("lang").agg(F.count_if("near").alias("n"), F.first("count").alias("count")).where(F.col("n") < F.least(F.lit(sample_rows), F.col("count"))).select("lang", F.lit(True).alias("short"))
    near = marked.join(held(short), "lang", "left").where(F.col("near") | F.col("short"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = near.withColumn("r", rank).where(F.col("r") <= sample_rows).select("lang", "h", "r")
    chosen = rows.join(held(picked), ["lang", "h"]).groupBy("lang", "r").agg(F.min(F.substring("text", 1, row_chars)).alias("text"))
    texts: dict[str, list[str]] = {}
    for label, _, part in sorted(chosen.collect()):  # at most labels x sample_rows short rows
        texts.setdefault(label, []).append(" ".join(part.lower().split()))
    return [(label, *suffix_automaton(" " + " ".join(shares(parts, sample_chars)))) for label, parts in sorted(texts.items())]


def shares(parts: list[str], total: int) -> list[str]:
    """The beginnings of all parts, as long as ``total`` allows when each gets an equal share of what shorter ones leave."""
    out, left = [], total
    for i, part in enumerate(sorted(parts, key=lambda x: (len(x), x))):
        out.append(part[: max(1, left // (len(parts) - i) - 1)])
        left -= len(out[-1]) + 1
    return out


def identify(df: DataFrame, trained: list, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (margin to the second, 0 to 1) and ``n_phrases`` of the winner."""
    labels = [t[0] for t in trained]
    shared = df.sparkSession.sparkContext.broadcast([t[1:] for t in trained])

    def make():
        wordcodes.held()
        memo = PhraseCounts(shared.value)

        def judge(texts):
            texts = [t or b"" for t in texts]
            if not labels:
                return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "n_phrases": [0] * len(texts)}
            buf, edges, starts, ends = memo.segment(texts)
            figures, _ = memo.pool_ids(memo.positions(buf, starts, ends))
            total = np.concatenate([np.zeros((1, len(labels) + 1), np.int64), np.cumsum(figures.reshape(-1, len(labels) + 1), axis=0, dtype=np.int64)])
            own = np.diff(total[np.searchsorted(starts, edges)], axis=0)
            rate = own[:, 1:] / np.maximum(own[:, :1], 1)
            best = np.argmin(rate, axis=1)
            low = rate[np.arange(len(texts)), best]
            second = np.partition(rate, 1, axis=1)[:, 1] if len(labels) > 1 else np.ones(len(texts))
            score = np.clip(1 - low / np.maximum(second, 1e-12), 0, 1)
            lettered = [_has_letter(t) for t in texts]
            return {
                "lang_pred": [labels[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)],
                "score": [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)],
                "n_phrases": own[np.arange(len(texts)), best + 1],
            }

        return judge

    return map_texts(df, make, "lang_pred string, score double, n_phrases long", text, keep)


def fold_of(doc_id: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
