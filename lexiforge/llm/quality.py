"""Quality rules from tokeniser fertility.

Public vocabularies measure how a text falls into tokens: characters per
token, the share of tokens that are single fallback bytes, and the entropy of
the text's token distribution.  Ordinary prose of a language lies in a narrow
band of each; keyboard noise, encoded data, symbol runs and endless repetition
leave it.  Bands are given per language and, where a language has none, per
script.

Defined results: a null text counts as empty; an empty text has no words and
fails the base rules; ties and repeated rows are judged alike; a null id is
carried, a null language means the bands of the script; very long texts, and very
long words, are measured whole; an empty table gives an empty result; extra columns
are carried along, one named like a result column gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lexiforge.llm import wordcodes
from lexiforge.llm.common import map_texts, vocabulary_path

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Inclusive limits; entropy counts only from ``entropy_from`` tokens on."""

    chars_per_token: tuple[float, float]
    chars_per_token_2: tuple[float, float]
    byte_share: float
    entropy_bits: float
    entropy_from: int = 64


#: Bands by language, for the vocabularies ``piece_bpe_32k`` and ``byte_bpe_multi_50k``.
LANGUAGE_BANDS = {
    "en": Band((1.70, 9.0), (1.93, 9.5), 0.12, 3.6),
    "de": Band((1.75, 9.0), (2.03, 9.5), 0.12, 3.6),
    "es": Band((1.65, 9.0), (1.86, 9.5), 0.12, 3.6),
    "fr": Band((1.55, 9.0), (1.77, 9.5), 0.12, 3.6),
}

#: Bands by script of most letters, for texts of any other or no language.
SCRIPT_BANDS = {
    "latin": Band((1.45, 9.0), (1.45, 9.5), 0.12, 3.6),
    "cyrillic": Band((1.0, 9.0), (1.0, 9.5), 0.20, 3.6),
    "greek": Band((0.7, 9.0), (0.7, 9.5), 0.30, 3.6),
    "han": Band((0.25, 4.0), (0.25, 4.5), 0.95, 3.6),
    "other": Band((0.2, 9.0), (0.2, 9.5), 1.0, 3.6),
    "none": Band((0.9, 4.0), (0.9, 4.5), 0.20, 3.6),
}

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, chars_per_token_2 double, byte_share double, entropy_bits double, reason string"
)


def _script_of(text: bytes) -> str:
    """Script of most letters, from UTF-8 lead bytes."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    counts = {
        "latin": int(n[65:91].sum() + n[97:123].sum() + n[0xC3:0xC9].sum()),
        "greek": int(n[0xCD:0xD0].sum()),
        "cyrillic": int(n[0xD0:0xD4].sum()),
        "other": int(n[0xD4:0xE3].sum() + n[0xEA:0xEE].sum()),
        "han": int(n[0xE3:0xEA].sum()),
    }
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


def _repeat_words(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Words per text that lie in an 8-word window found at least twice in it."""
    n, docs = len(at), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    if n < _WINDOW:
        return np.zeros(len(edges) - 1, np.int64)
    key = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(key * wordcodes.powers("r", n))])
    h = (total[_WINDOW:] - total[:-_WINDOW]) * wordcodes.powers("i", n)[: n - _WINDOW + 1]
    h = (h ^ (h >> np.uint64(31))) + docs[: n - _WINDOW + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = np.flatnonzero(docs[: n - _WINDOW + 1] == docs[_WINDOW - 1 :])
    _, inverse, counts = np.unique(h[whole], return_inverse=True, return_counts=True)
    hits = whole[counts[inverse] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + _WINDOW, -1)
    return np.bincount(docs, (np.cumsum(cover[:-1]) > 0), len(edges) - 1).astype(np.int64)


def _token_figures(memo: wordcodes.WordMemo, at: np.ndarray, word_edges: np.ndarray):
    """Tokens, fallback bytes and entropy in bits, per text."""
    ids, stops = memo.pool_ids(at)
    edges = np.concatenate([[0], stops])[word_edges]
    n_docs, tokens = len(edges) - 1, np.diff(edges)
    docs = np.repeat(np.arange(n_docs), tokens)
    byte = np.bincount(docs, memo.is_byte[ids], n_docs) if hasattr(memo, "is_byte") else np.zeros(n_docs)
    pair, counts = np.unique(docs * np.int64(memo.size + 1) + ids, return_counts=True)
    of = pair // (memo.size + 1)
    plogp = np.bincount(of, counts * np.log2(counts), n_docs)
    size = np.maximum(tokens, 1)
    return tokens, byte / size, np.maximum(np.log2(size) - plogp / size, 0.0)


def measure(texts: list, langs: list, piece: wordcodes.PieceWords, rank: wordcodes.RankWords, bands: dict, script_bands: dict) -> dict:
    """All figures and verdicts of one block of texts."""
    texts = [t or b"" for t in texts]
    buf, edges, starts, ends = piece.segment(texts)
    at = piece.positions(buf, starts, ends)
    word_edges = np.searchsorted(starts, edges)
    n_words = np.diff(word_edges)
    word_chars = np.array([len(t.decode()) - (len(t) - len(t.translate(None, _BLANKS))) for t in texts], np.int64)
    n_symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64)
    n_dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip(_BLANKS)]
            n_dup[i] = len(lines) - len(set(lines))
    repeat = _repeat_words(at, word_edges)
    tokens, byte_share, entropy = _token_figures(piece, at, word_edges)
    per_token = word_chars / np.maximum(tokens, 1)
    _, stops = rank.pool_ids(rank.positions(buf, starts, ends))
    per_token_2 = word_chars / np.maximum(np.diff(np.concatenate([[0], stops])[word_edges]), 1)
    base = (n_words < 20) | (100 * repeat > 30 * n_words)
    scripts = [_script_of(t) for t in texts]
    reason = []
    for i, s in enumerate(scripts):
        band = bands.get(langs[i]) or script_bands.get(s, script_bands["other"])
        (low, high), (low_2, high_2) = band.chars_per_token, band.chars_per_token_2
        reason.append(
            "base" if base[i]
            else "chars_per_token" if not (low <= per_token[i] <= high and low_2 <= per_token_2[i] <= high_2)
            else "byte_share" if byte_share[i] > band.byte_share
            else "entropy" if tokens[i] >= band.entropy_from and entropy[i] < band.entropy_bits
            else None
        )
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat,
        "base_failed": base, "kept": np.array([r is None for r in reason], bool), "script": scripts, "n_tokens": tokens,
        "chars_per_token": per_token, "chars_per_token_2": per_token_2, "byte_share": byte_share, "entropy_bits": entropy, "reason": reason,
    }


def fertility(
    df: DataFrame,
    text: str = "text",
    lang: str | None = "lang",
    keep: list[str] | None = None,
    piece_path: str | None = None,
    rank_path: str | None = None,
    bands: dict = LANGUAGE_BANDS,
    script_bands: dict = SCRIPT_BANDS,
) -> DataFrame:
    """Every row of ``df`` with its figures, ``kept`` and the ``reason`` of a rejection."""
    import public_tokenizers

    piece_path = piece_path or vocabulary_path("piece_bpe_32k.model")
    rank_path = rank_path or vocabulary_path("byte_bpe_multi_50k.tiktoken")
    pattern = public_tokenizers.PATTERN

    def make():
        piece, rank = wordcodes.held((wordcodes.PieceWords, piece_path), (wordcodes.RankWords, rank_path, pattern))
        return lambda texts, langs=None: measure(texts, langs or [None] * len(texts), piece, rank, bands, script_bands)

    return map_texts(df, make, FIELDS, text, keep, also=(lang,) if lang and lang in df.columns else ())
