"""Near-duplicate detection with SetSketch registers.

A document is the set of its word shingles.  Every register keeps the least of
an exponential hash over the set, on an exponentially spaced, truncated scale
(base ``b``): a sketch of the union of two sets is the larger register at each
place, and registers agree about as often as the sets overlap.

1. Documents of one set become one node (pre-aggregated, so copies cost
   nothing later).
2. Bands of registers are hashed; each bucket links its members to its hub, the
   member that meets most others over all bands.  Pairs that their exact sizes rule out go.
3. The overlap of a pair is estimated by maximum likelihood from how many
   registers are larger, smaller and equal; pairs far below the threshold go.
4. The rest is verified on the full sets.
5. Buckets that still hold several components are searched completely, in
   blocks of bounded bytes that hold the full sets: pairs of different
   components are estimated, verified at once, and a block tells one link for
   each two components it joins.  So no link is lost to the choice of the hub,
   and no list of pairs leaves a block.

With 160 registers in 32 bands of 5, a pair of overlap 0.8 shares no bucket
with probability 3e-6, and falls below the estimate's floor of 0.64 with 3e-7.
Sets are told apart by 128 bits.

Defined results: null and wordless texts have an empty set and link with
nothing; a text of fewer words than a shingle is one shingle; very long texts
are one set like any other; repeated rows share a component; components are
named by their least id, so ties do not matter; a null id counts as absent when
the least id is taken; an empty table gives an empty result; columns besides id
and text, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import wordcodes
from lexiforge.llm.common import Scratch, blocks
from lexiforge.llm.components import connected

REGISTERS, BANDS, BASE, RATE, TOP = 160, 32, 1.001, 20.0, 2**16 - 2
_BLOCK = 1_000_000
_rng = np.random.default_rng(6)
_MULTIPLY = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], k: int):
    """Distinct 64-bit shingle hashes of all texts in a row, ascending in each, and where each text's start."""
    buf, edges = wordcodes.join_texts(texts)
    low = wordcodes._LOWER[buf]
    starts, ends = wordcodes.find_words(low)
    word = wordcodes.hash_spans(low, starts, ends)
    first = np.searchsorted(starts, edges)
    counts = np.diff(first)
    n = len(word)
    docs = np.repeat(np.arange(len(texts)), counts)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = (h ^ word[i : n - k + 1 + i]) * np.uint64(0x9FB21C651E98DF25 + 2 * i)
            h ^= h >> np.uint64(32)
        whole = docs[: n - k + 1] == docs[k - 1 :]
        h, of = h[whole], docs[: n - k + 1][whole]
    else:
        h, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = [(i, low[edges[i] : edges[i + 1]].tobytes().split()) for i in np.flatnonzero((counts > 0) & (counts < k)).tolist()]
    if short:
        own = np.array([int.from_bytes(hashlib.blake2b(b" ".join(w), digest_size=8, salt=b"short").digest(), "little") for _, w in short], np.uint64)
        h, of = np.concatenate([h, own]), np.concatenate([of, [i for i, _ in short]])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def registers(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set; rows of empty sets are 0."""
    full = np.flatnonzero(np.diff(edges))
    out = np.zeros((len(edges) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    at, least = edges[full], np.empty((len(full), REGISTERS))
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat(h * _MULTIPLY[j] + _ADD[j], at)
    x = -np.log1p(-np.minimum((least + 1.0) / 2.0**64, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard overlap from the counts of larger and smaller registers and the set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - larger - smaller

    def likelihood(j):
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        more, less = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-300))
        return larger * log(more) + smaller * log(less) + equal * log(1 - more - less)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def reaches(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> np.ndarray:
    """Is the likeliest overlap ``floor`` or more?  The likelihood has one peak, so its slope at the floor tells."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal, q = REGISTERS - larger - smaller, (BASE - 1) / BASE
    x, y = np.maximum(u - v * floor, 1e-12), np.maximum(v - u * floor, 1e-12)
    p = lambda z: -np.log1p(-np.minimum(z, 1) * q) / np.log(BASE)
    rise = lambda z: q / (1 - np.minimum(z, 1) * q) / np.log(BASE)
    slope = equal * (v * rise(x) + u * rise(y)) / np.maximum(1 - p(x) - p(y), 1e-12) - larger * v * rise(x) / p(x) - smaller * u * rise(y) / p(y)
    return (slope >= 0) & (np.minimum(n_a, n_b) >= floor * np.maximum(n_a, n_b))


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        wordcodes.held()
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for s, e in blocks([len(t) for t in texts], _BLOCK):
                h, edges = shingle_sets(texts[s:e], k)
                sketch, n = registers(h, edges), np.diff(edges)
                prints = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["doc_id", "th", "n", "print", "regs"],
                )
        wordcodes.tidy()

    return docs.mapInArrow(run, "doc_id long, th long, n long, print binary, regs binary")


def _shingled(docs: DataFrame, k: int) -> DataFrame:
    """(print, set) of texts; copies within a block are told once."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = list({t: x or b"" for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)}.values())
            for s, e in blocks([len(t) for t in texts], _BLOCK):
                h, edges = shingle_sets(texts[s:e], k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h.view(np.int64), pa.int64())),
                    ],
                    names=["print", "set"],
                )
        wordcodes.tidy()

    return docs.mapInArrow(run, "print binary, set array<long>")


def _estimated(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose likeliest overlap reaches the floor."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            keep = pa.array(reaches((left > right).sum(1), (left < right).sum(1), n_a.astype(float), n_b.astype(float), floor))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], names=["a", "b", "n_a", "n_b"])

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    full = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    return full.mapInArrow(run, "a long, b long, n_a long, n_b long")


def _sets(asked: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, most_held: int, scratch: Scratch) -> DataFrame:
    """(node, set) of the nodes in ``asked``, shingled again from one text of each."""
    asked = scratch.put(asked.distinct().join(nodes.select("node", "th", "print"), "node"), "asked")
    few = asked.count() <= most_held  # 8 bytes each
    wanted = asked.select("th").distinct()
    texts = docs.join(F.broadcast(wanted) if few else wanted, "th", "left_semi").select("doc_id", "th", "text")
    found = _shingled(texts, k).groupBy("print").agg(F.first("set").alias("set"))
    return scratch.put(found.join(asked.select("print", "node"), "print").select("node", "set"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, most_held: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose full sets overlap by ``percent``, as edges (u, v)."""
    pairs = scratch.put(pairs, "pairs")
    sets = _sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), docs, nodes, k, most_held, scratch)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "n_a", "n_b", shared.alias("shared")).where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("u", "v")


class Members(NamedTuple):
    """Arrays of one side of a block; sets are ascending hashes."""

    node: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    regs: np.ndarray
    sets: list


def _likely_pairs(a: Members, b: Members, band: int, percent: int, floor: float, at_once: int = 16_384):
    """Pairs (places in a, places in b) of different components whose estimate reaches the floor."""
    per = REGISTERS // BANDS
    step = max(1, at_once // len(b.node))
    for low in range(0, len(a.node), step):
        own = slice(low, low + step)
        n, m = a.n[own, None], b.n[None, :]
        i, j = np.nonzero((a.comp[own, None] != b.comp[None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
        i += low
        if len(i) and band:  # a pair is told in the first band it shares
            same = a.regs[i, : band * per] == b.regs[j, : band * per]
            fresh = ~same.reshape(len(i), band, per).all(2).any(1)
            i, j = i[fresh], j[fresh]
        if len(i):
            left, right = a.regs[i], b.regs[j]
            near = reaches((left > right).sum(1), (left < right).sum(1), a.n[i].astype(float), b.n[j].astype(float), floor)
            yield i[near], j[near]


def links_of_block(a: Members, b: Members, band: int, percent: int, floor: float) -> list[tuple[int, int]]:
    """Links between different components of two groups of members, one for each two components they join."""
    above: dict[int, int] = {}  # components joined here

    def top(c):
        while c in above:
            c = above[c]
        return c

    found = []
    for i, j in _likely_pairs(a, b, band, percent, floor):
        for p in np.unique(i).tolist():
            near = [q for q in j[i == p].tolist() if top(int(b.comp[q])) != top(int(a.comp[p]))]
            if not near:
                continue
            theirs = np.concatenate([b.sets[q] for q in near])
            sizes = b.n[near]
            spot = np.minimum(np.searchsorted(a.sets[p], theirs), int(a.n[p]) - 1)
            shared = np.add.reduceat(a.sets[p][spot] == theirs, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero(100 * shared >= percent * (int(a.n[p]) + sizes - shared)).tolist():
                mine, its = top(int(a.comp[p])), top(int(b.comp[near[k]]))
                if mine != its:
                    found.append((int(a.node[p]), int(b.node[near[k]])))
                    above[its] = mine
    return found


def _cross_links(members: DataFrame, percent: int, floor: float, block: int) -> DataFrame:
    """Links (u, v) between different components that share a bucket, found in blocks of bounded bytes.

    members: key, band, node, n, comp, regs, set, main (is in the component of
    the bucket's hub).  Members of the main component only meet the others.
    block: sum of set sizes and registers on either side of a block.
    """
    import pandas as pd

    weight = F.col("n") + REGISTERS // 4
    parts = lambda w: F.greatest(F.ceil(F.sum(w) / block), F.lit(1))
    sizes = members.groupBy("key").agg(parts(F.when(~F.col("main"), weight)).alias("rows"), parts(weight).alias("cols"))
    dealt = members.join(sizes, "key").withColumn("h", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(2**31)))
    row, col = F.col("h") % F.col("rows"), F.col("h") % F.col("cols")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    as_row = dealt.where(~F.col("main")).select("*", row.cast("long").alias("i"), spread(F.col("cols")).alias("j"), F.lit(True).alias("in_row"))
    as_col = dealt.select("*", spread(F.col("rows")).alias("i"), col.cast("long").alias("j"), F.lit(False).alias("in_row"))
    columns = ["task", "key", "i", "j", "band", "node", "n", "comp", "regs", "set", "in_row"]
    # small buckets share a task, a block of a large one has its own
    total = members.agg(F.sum(weight)).first()[0] or 0
    shared_task = F.pmod(F.xxhash64("key"), F.lit(max(1, int(2 * total // block))))
    task = F.when((F.col("rows") == 1) & (F.col("cols") == 1), shared_task).otherwise(-1 - F.pmod(F.xxhash64("key", "i", "j"), F.lit(2**62))).alias("task")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "i", "j", "in_row"], kind="stable")
        regs = np.frombuffer(b"".join(pdf.regs), np.uint16).reshape(-1, REGISTERS)
        node, comp, n, sets, band, in_row = (pdf[c].to_numpy() for c in ("node", "comp", "n", "set", "band", "in_row"))
        blocks = pdf[["key", "i", "j"]].to_numpy()
        heads = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]).any(1)))
        found = []
        for low, high in zip(heads, np.append(heads[1:], len(pdf)), strict=True):
            mid = low + int((~in_row[low:high]).sum())
            side = lambda x: Members(node[x], comp[x], n[x], regs[x], sets[x])
            if low < mid < high:
                found += links_of_block(side(slice(mid, high)), side(slice(low, mid)), int(band[low]), percent, floor)
        wordcodes.tidy()
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    tasks = as_row.withColumn("task", task).select(columns).unionByName(as_col.withColumn("task", task).select(columns))
    return tasks.groupBy("task").applyInPandas(compare, "u long, v long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, floor: float = 0.64, block: int = 1 << 19, most_held: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, th) of every row; th is the hash of its text.

    Rows whose sets overlap by ``percent`` or more (Jaccard) are linked;
    component_id is the least id reachable over links, the row's own included.
    ``most_held`` bounds the text hashes held by every executor; more are met
    in a shuffled join.  ``block`` bounds the shingles on a side of a block.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("th"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    sketch = scratch.put(_sketch(docs, k), "sketch")
    once = sketch.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("th").alias("th"), F.first("regs").alias("regs"))
    nodes = scratch.put(once.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once: it is written at once
    per = 2 * (REGISTERS // BANDS)
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * per + 1, per)) for i in range(BANDS)])
    banded = nodes.select("node", "n", F.posexplode(keys).alias("band", "key"))
    met = scratch.put(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "met")
    shared = scratch.put(banded.join(met, "key"), "shared")
    # a node that meets many others in its bands is likely the text the others were made from
    degree = scratch.put(shared.groupBy("node").agg(F.sum("members").alias("degree")), "degree")
    known_degree = shared.join(degree, "node").drop("members")
    hubs = scratch.put(known_degree.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("rep")), "hubs")
    placed = scratch.put(shared.drop("members").join(hubs, "key"), "placed")
    scratch.drop("met", "shared", "degree", "hubs")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    stars = placed.select(F.col("rep.node").alias("a"), F.col("node").alias("b"), F.col("rep.n").alias("n_a"), F.col("n").alias("n_b")).where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()
    links = scratch.put(_verified(_estimated(stars, nodes, floor), docs, nodes, k, percent, most_held, scratch), "links")
    scratch.drop("pairs", "asked", "sets")
    first = connected(links)

    # what the hubs did not link
    comp = F.coalesce("root", "node")
    known = placed.join(first, "node", "left").select("key", "band", "node", "n", comp.alias("comp"), F.col("rep.node").alias("rep"))
    torn = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = scratch.put(known.join(torn, "key", "left_semi"), "rest")
    scratch.drop("placed")
    if not rest.isEmpty():
        main = rest.where("node = rep").select("key", F.col("comp").alias("rep_comp"))
        full = scratch.put(_sets(rest.select("node"), docs, nodes, k, most_held, scratch).join(nodes.select("node", "regs"), "node"), "full")
        marked = scratch.put(rest.join(main, "key").select("key", "band", "node", "n", "comp", (F.col("comp") == F.col("rep_comp")).alias("main")), "marked")
        crossed = scratch.put(_cross_links(marked.join(full, "node"), percent, floor, block), "crossed")
        scratch.drop("asked", "sets", "full", "marked")
        if not crossed.isEmpty():
            first = connected(links.unionByName(crossed))
    # both written: a component that holds most nodes is then split in the join
    labelled = scratch.put(nodes.join(first, "node", "left").select("node", "print", "label", comp.alias("comp")), "labelled")
    least = scratch.put(labelled.groupBy("comp").agg(F.min("label").alias("component_id")), "least")
    of_print = scratch.put(labelled.join(least, "comp").select("print", "component_id"), "named")
    scratch.drop("rest", "links", "crossed", "nodes", "labelled", "least")
    return sketch.select("doc_id", "th", F.col("n").alias("n_shingles"), "print").join(of_print, "print", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "th")
