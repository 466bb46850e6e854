"""Cost-balanced packing of token ids into fixed-length training sequences.

A sequence costs ``linear * n + quadratic * n**2`` for every piece of ``n``
tokens in it (attention does not cross pieces).  Documents are dealt by
descending length: each goes to the cheapest sequence that still has room for
all of it; one that fits nowhere is cut, filling the cheapest sequence first.
Documents over the sequence length give full sequences and a rest.

Packing runs in blocks of ``block_sequences`` sequences inside each partition,
so memory is bounded and nothing is shuffled.  A block of ``T`` tokens opens
``T // seq_len`` sequences and fills them to the last token; the tail of fewer
than ``seq_len`` tokens goes to the sequences of the binary digits of its size
(1,024 + 256 + ...), which need no padding.

Defined results: a null text is empty and holds only the end id; repeated rows
are packed one by one; a null id stays null; ties of length keep the order of the
rows; a very long text gives full sequences and a rest, even where it is longer
than a block; an empty table gives an empty result; columns besides the id and the
text, whatever their names, are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import wordcodes
from lexiforge.llm.common import blocks, vocabulary_path

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


def assign(lengths: np.ndarray, seq_len: int, linear: float, quadratic: float):
    """Pieces ``(document, start, length, sequence, offset)`` and each sequence's cost.

    Sequences 0 .. T // seq_len - 1 are full, later ones have a power of two.
    """
    total = int(lengths.sum())
    full, tail = divmod(total, seq_len)
    caps = np.array([seq_len] * full + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1], np.int64)
    room, cost = caps.copy(), np.zeros(len(caps))
    pieces = []

    def put(doc, start, n, seq):
        pieces.append((doc, start, n, seq, int(caps[seq] - room[seq])))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    # whole sequences out of long documents; they are as dear as a sequence can be
    rests, at = [], 0
    for doc in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[doc]), 0
        while n >= seq_len and at < full:
            put(doc, start, seq_len, at)
            at, start, n = at + 1, start + seq_len, n - seq_len
        if n:
            rests.append((n, doc, start))
    rests.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in rests:
        open_cost = np.where(room >= n, cost, np.inf)
        seq = int(np.argmin(open_cost)) if len(caps) else 0
        if open_cost[seq] < np.inf:
            put(doc, start, n, seq)
            continue
        while n:
            seq = int(np.argmin(np.where(room > 0, cost, np.inf)))
            take = min(n, int(room[seq]))
            put(doc, start, take, seq)
            start, n = start + take, n - take
    return pieces, cost


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seq_len: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_sequences: int = 1024,
) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) and its sequence's cost."""
    import pyarrow as pa

    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    limit = seq_len * block_sequences

    def run(batches):
        from pyspark import TaskContext

        (memo,) = wordcodes.held((wordcodes.BpeWords, path))
        base, n_blocks = TaskContext.get().partitionId() << 40, 0
        held_ids, held, held_tokens = [], [], 0

        def flush():
            nonlocal n_blocks, held_ids, held, held_tokens
            doc_ids = [d for d, _ in held]
            pieces, cost = assign(np.array([len(x) for _, x in held], np.int64), seq_len, linear, quadratic)
            first = base + (n_blocks << 20)
            doc, start, n, seq, off = (list(x) for x in zip(*pieces, strict=True)) if pieces else ([],) * 5
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([len(held[d][1]) for d in doc], pa.int64()), pa.array([first + s for s in seq], pa.int64()),
                    pa.array(off, pa.int64()), pa.array([float(cost[s]) for s in seq], pa.float64()),
                    pa.array([held[d][1][s : s + k].tobytes() for d, s, k in zip(doc, start, n, strict=True)], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "ids"],
            )
            n_blocks, held, held_tokens = n_blocks + 1, [], 0
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for s, e in blocks([len(t) for t in texts], 1_000_000):
                ids, edges = memo.encode(texts[s:e])
                for i in range(s, e):
                    part = ids[edges[i - s] : edges[i - s + 1]]
                    held.append((keys[i], np.append(part, np.uint32(end_id)).astype("<u4")))
                    held_tokens += len(part) + 1
                    if held_tokens >= limit:
                        yield flush()
        if held:
            yield flush()

    source = df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string").cast("binary"))
    return source.mapInArrow(run, SCHEMA)
