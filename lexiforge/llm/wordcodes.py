"""Whole-text encoding through a bounded memo of words.

No merge of the three libraries crosses ASCII white space, so the ids of a
text are the ids of its white-space separated words, one after the other:

* ``word_bpe_49k.json`` drops white space; its normaliser (NFC, white space,
  lower case) and its pre-tokenizer never join what ASCII white space parts,
  nor a letter a-z and the punctuation that ends a word;
* for the sentencepiece and rank vocabularies the measure is *defined* on
  words (each with a leading word boundary).

A worker therefore asks the library once per distinct word.  Words of a block
of documents are found, hashed (64 bits over random byte values) and looked up
as arrays; the ids of the block are then gathered from flat arrays.  A memo
holds at most ``CAPACITY`` bytes and is emptied when full, and a worker keeps the
memos of one operator only (``held``), so memory follows neither the vocabulary
nor the number of operators a reused worker has served.
"""

from __future__ import annotations

import contextlib
import re

import numpy as np

from lexiforge.llm.common import worker_env

#: Bytes of words a memo remembers before it starts afresh.
CAPACITY = 32 << 20
_TAIL = np.isin(np.arange(256), list(b".,!?;:"))
_LETTER = np.isin(np.arange(256), range(97, 123))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_PLAIN = re.compile(rb"[a-z]+\Z")
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 2**64)
_POWERS = {"r": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base ('r') or its inverse ('i') modulo 2**64."""
    have = _POWERS[kind]
    while len(have) < n:
        step = np.uint64(pow(_R if kind == "r" else _R_INVERSE, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _POWERS[kind] = have
    return have[:n]


def join_texts(texts: list[bytes]):
    """One buffer with a space after each text, and where each text starts (one more at the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def find_words(buf: np.ndarray):
    """Starts and ends of the runs outside `[\\x20\\x09-\\x0D]`."""
    word = np.concatenate([[False], ~_SPACE[buf], [False]])
    turns = np.flatnonzero(word[1:] != word[:-1])
    return turns[::2], turns[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * powers("r", len(buf)), out=total[1:])
    h = (total[ends] - total[starts]) * powers("i", len(buf) + 1)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def part_tails(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Cut each word between a last letter a-z and the punctuation that ends the word."""
    core = ends.copy()
    live = np.flatnonzero(_TAIL[buf[core - 1]])
    while len(live):
        core[live] -= 1
        live = live[core[live] > starts[live]]
        live = live[_TAIL[buf[core[live] - 1]]]
    cut = (core > starts) & (core < ends)
    cut[cut] = _LETTER[buf[core[cut] - 1]]
    at = np.flatnonzero(cut) + 1
    return np.insert(starts, at, core[cut]), np.insert(ends, at - 1, core[cut])


class _Pool:
    """Growing flat array of ids, addressed by position."""

    def __init__(self):
        self.values, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def extend(self, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        while self.used + total > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while self.n + len(lists) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
        self.values[self.used : self.used + total] = [x for part in lists for x in part]
        self.starts[self.n : self.n + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(lists)] = sizes
        self.used, self.n = self.used + total, self.n + len(lists)

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + self.starts.nbytes + self.sizes.nbytes

    def gather(self, at: np.ndarray):
        """Ids of all positions in a row, and where those of each position end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return self.values[:0], ends
        return self.values[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])], ends


class WordMemo:
    """Subclasses say how a list of words is encoded and what a block's words are."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), _Pool()

    def segment(self, texts: list[bytes]):
        buf, edges = join_texts(texts)
        return buf, edges, *find_words(buf)

    def encode_words(self, words: list[bytes]) -> list:
        raise NotImplementedError

    def positions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pool position of each word; equal words have equal positions within one call."""
        if self.keys.nbytes + self.slots.nbytes + self.pool.nbytes > self.capacity:
            self.clear()
        keys, first, inverse = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        slots = np.empty(len(keys), np.int64)
        slots[known] = self.slots[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = buf.tobytes()
            slots[fresh] = self.pool.n + np.arange(len(fresh))
            self.pool.extend(self.encode_words([data[s:e] for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)]))
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
            self.slots = np.insert(self.slots, at[fresh], slots[fresh])
        return slots[inverse]

    def encode(self, texts: list[bytes]):
        """Ids of all texts in a row, and where those of each text start (one more at the end)."""
        buf, edges, starts, ends = self.segment(texts)
        ids, stops = self.pool_ids(self.positions(buf, starts, ends))
        return ids, np.concatenate([[0], stops])[np.searchsorted(starts, edges)]

    def pool_ids(self, at: np.ndarray):
        return self.pool.gather(at)


class BpeWords(WordMemo):
    """``word_bpe_49k.json`` by the tokenizers library, ``add_special_tokens=False``."""

    def __init__(self, path: str, capacity: int = 3 * CAPACITY // 2):  # no operator holds another beside it
        worker_env()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        super().__init__(capacity)

    def segment(self, texts):
        buf, edges = join_texts(texts)
        low = _LOWER[buf]
        for i, t in enumerate(texts):
            if b"<|" in t:  # lower-casing could make a special token's string
                low[edges[i] : edges[i + 1]] = buf[edges[i] : edges[i + 1]]
        return low, edges, *part_tails(low, *find_words(low))

    def encode_words(self, words):
        model, out, rest = self.model, [None] * len(words), []
        for i, w in enumerate(words):
            if _PLAIN.match(w):  # what normaliser and pre-tokenizer leave as it is
                out[i] = [t.id for t in model.tokenize(w.decode())]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class PieceWords(WordMemo):
    """A sentencepiece model; ``is_byte`` marks its byte-fallback pieces."""

    def __init__(self, path: str, capacity: int = CAPACITY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        super().__init__(capacity)

    def encode_words(self, words):
        return self.model.encode([w.decode() for w in words], num_threads=1)


class RankWords(WordMemo):
    """A rank file by tiktoken; each word after the pattern's leading space."""

    def __init__(self, path: str, pattern: str, capacity: int = CAPACITY):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = len(ranks)
        super().__init__(capacity)

    def encode_words(self, words):
        return [self.model.encode_ordinary(" " + w.decode()) for w in words]


_LOADED: dict = {}


def held(*wanted) -> list:
    """The memos of one operator, each given as (kind, *arguments).

    A worker keeps them between tasks; those of any other operator go.
    """
    keys = [(kind.__name__, *args) for kind, *args in wanted]
    if set(_LOADED) - set(keys):
        for other in set(_LOADED) - set(keys):
            del _LOADED[other]
        tidy()
    for key, (kind, *args) in zip(keys, wanted, strict=True):
        if key not in _LOADED:
            _LOADED[key] = kind(*args)
    return [_LOADED[k] for k in keys]


def tidy() -> None:
    """Give freed memory of this worker back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    _POWERS.update(r=_POWERS["r"][:1].copy(), i=_POWERS["i"][:1].copy())
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
