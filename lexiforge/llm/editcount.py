"""Edit-aware token counts.

Every document keeps a segment tree over its pre-tokens: leaves are runs of
``leaf_words`` words, cut where a word starts after white space, and each inner
node holds the sum of its two children, so the root is the token count.  An
edit replaces a stretch of characters.  Only the leaves it touches are encoded
again, together with the leaf behind them where the edit reaches a boundary;
then the sums on the way to the root change.  Touched leaves become one leaf, or
several once their words would fill more than two, so leaves keep their size
over any number of edits; where the number of leaves changes, the sums are added
up anew from the leaves' counts.  Counts equal those of encoding the edited text
anew.

Defined results: null texts are empty, with one leaf of no tokens; null edits
mean none; edits are applied in order of position, ones that overlap an
earlier one or lie beyond the end are cut to what is left, ties of a position go
to the shorter cut, then the lesser text; repeated rows are separate documents; a
null id is carried like any other; very long texts have more leaves, a very long
word is one leaf; an empty table gives an empty result; extra columns are carried
along, one named like a result column gives way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.llm import wordcodes
from lexiforge.llm.common import blocks, map_texts, vocabulary_path

TREE_FIELDS = "n_tokens long, leaf_ends array<int>, tree array<int>"
EDITED_FIELDS = "edited_text string, n_tokens_after long, leaf_ends_after array<int>, tree_after array<int>, n_edits int, n_leaves int, n_leaves_encoded int, n_chars_encoded long"


def build_tree(counts: np.ndarray) -> np.ndarray:
    """Heap-ordered sums: node i has children 2i and 2i + 1, the root is node 1, leaf j is node size + j."""
    size = 1
    while size < len(counts):
        size *= 2
    tree = np.zeros(2 * size, np.int32)
    tree[size : size + len(counts)] = counts
    while size > 1:
        size //= 2
        tree[size : 2 * size] = tree[2 * size : 4 * size : 2] + tree[2 * size + 1 : 4 * size : 2]
    return tree


def set_leaf(tree: np.ndarray, leaf: int, count: int) -> None:
    """Put ``count`` into a leaf and add the difference on the way to the root."""
    node = len(tree) // 2 + leaf
    change = count - int(tree[node])
    while node:
        tree[node] += change
        node //= 2


def leaves_of(memo: wordcodes.BpeWords, texts: list[bytes], leaf_words: int):
    """Per text: ends of its leaves in characters, and the tokens of each leaf."""
    buf, edges = wordcodes.join_texts(texts)
    low, _, starts, ends = memo.segment(texts)
    _, stops = memo.pool_ids(memo.positions(low, starts, ends))
    words, _ = wordcodes.find_words(buf)
    total = np.concatenate([[0], stops])
    upto = total[np.searchsorted(starts, words)]  # tokens before each word
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    first = np.searchsorted(words, edges)
    out = []
    for i in range(len(texts)):
        heads = words[first[i] : first[i + 1]][::leaf_words][1:]
        cuts = np.concatenate([upto[first[i] : first[i + 1]][::leaf_words][1:], [total[np.searchsorted(starts, edges[i + 1])]]])
        before = total[np.searchsorted(starts, edges[i])]
        out.append((chars[np.concatenate([heads, [edges[i + 1] - 1]]).astype(np.int64)] - chars[edges[i]], np.diff(np.concatenate([[before], cuts]))))
    return out


def build_trees(df: DataFrame, text: str = "text", keep: list[str] | None = None, leaf_words: int = 32, vocabulary: str | None = None) -> DataFrame:
    """``df`` with the token count and the segment tree of every text."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")

    def make():
        (memo,) = wordcodes.held((wordcodes.BpeWords, path))

        def run(texts):
            leaves = leaves_of(memo, [t or b"" for t in texts], leaf_words)
            return {"n_tokens": [int(c.sum()) for _, c in leaves], "leaf_ends": [e.astype(np.int32) for e, _ in leaves], "tree": [build_tree(c) for _, c in leaves]}

        return run

    return map_texts(df, make, TREE_FIELDS, text, keep)


class Edited:
    """One document while its edits are applied."""

    def __init__(self, text: str, ends: np.ndarray, tree: np.ndarray, edits: list):
        self.n_edits, self.ends, self.tree = 0, ends.copy(), tree.copy()
        out, done, regions = [], 0, []  # regions: first leaf, last leaf, new text in pieces
        n = len(text)
        for at, cut, put in sorted((max(0, e["at"] or 0), max(0, e["cut"] or 0), e["put"] or "") for e in edits):
            at = min(max(at, done), n)
            cut = min(cut, n - at)
            if not cut and not put:
                continue
            self.n_edits += 1
            low = int(np.searchsorted(ends, at, side="right"))
            high = int(np.searchsorted(ends, at + cut, side="right"))
            last = len(ends) - 1
            low, high = min(low, last), min(high, last)
            if not regions or low > regions[-1][1]:
                regions.append([low, high, []])
            else:
                regions[-1][1] = max(regions[-1][1], high)
            regions[-1][2].append((at, cut, put))
            out += [text[done:at], put]
            done = at + cut
        self.text = "".join([*out, text[done:]])
        self.spans = []
        for low, high, own in regions:
            begin, stop = int(ends[low - 1]) if low else 0, int(ends[high])
            parts, p = [], begin
            for at, cut, put in own:
                parts += [text[p:at], put]
                p = at + cut
            self.spans.append((low, high, "".join([*parts, text[p:stop]])))
        self.n_leaves_encoded = sum(high - low + 1 for low, high, _ in regions)

    def settle(self, leaves: list) -> None:
        """Put in the leaves (ends, tokens) of every region's new text; all other leaves keep their counts.

        A region becomes one leaf, or leaves of the usual size once it has more than two of them.
        """
        old, half = self.ends, len(self.tree) // 2
        ends, counts, at, shift, same = [], [], 0, 0, True
        for (low, high, span), (stops, tokens) in zip(self.spans, leaves, strict=True):
            if len(stops) <= 2:
                stops, tokens = stops[-1:], np.array([tokens.sum()])
            begin = int(old[low - 1]) if low else 0
            ends += [old[at:low] + shift, begin + shift + stops]
            counts += [self.tree[half + at : half + low], tokens]
            shift += len(span) - (int(old[high]) - begin)
            at = high + 1
            same &= low == high and len(stops) == 1
        self.ends = np.concatenate([*ends, old[at:] + shift]).astype(np.int32)
        if same:
            for (low, _, _), tokens in zip(self.spans, counts[1::2], strict=True):
                set_leaf(self.tree, low, int(tokens[0]))
        else:
            self.tree = build_tree(np.concatenate([*counts, self.tree[half + at : half + len(old)]]))


def apply_edits(trees: DataFrame, text: str = "text", edits: str = "edits", keep: list[str] | None = None, leaf_words: int = 32, vocabulary: str | None = None) -> DataFrame:
    """Apply ``edits`` (array of struct<at int, cut int, put string>, in characters) to every document.

    The result has the edited text with its tree, so further edits can follow.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    added = StructType.fromDDL(EDITED_FIELDS)
    types = [f.type for f in to_arrow_schema(added)]
    kept = [c for c in (trees.columns if keep is None else keep) if c not in added.names]
    source = trees.select(*[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("read"), "leaf_ends", "tree", F.col(f"`{edits}`").alias("edits"))
    schema = StructType([*source.schema.fields[: len(kept)], *added.fields])

    def run(batches):
        (memo,) = wordcodes.held((wordcodes.BpeWords, path))
        for batch in batches:
            texts, ends, tree, changes = (batch.column(len(kept) + i).to_pylist() for i in range(4))
            for s, e in blocks([len(t) for t in texts], 1_000_000):
                docs = [Edited(texts[i], np.array(ends[i]), np.array(tree[i]), changes[i] or []) for i in range(s, e)]
                spans = [x[2].encode() for d in docs for x in d.spans]
                leaves = iter(leaves_of(memo, spans, leaf_words) if spans else [])
                for d in docs:
                    d.settle([next(leaves) for _ in d.spans])
                columns = [
                    [d.text for d in docs], [int(d.tree[1]) for d in docs], [d.ends for d in docs], [d.tree for d in docs], [d.n_edits for d in docs],
                    [len(d.ends) for d in docs], [d.n_leaves_encoded for d in docs], [sum(len(x[2]) for x in d.spans) for d in docs],
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(s, e - s) for i in range(len(kept))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*kept, *added.names)
