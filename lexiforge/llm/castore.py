"""Content-addressed store of token ids.

Every text is encoded whole and closed by the end id.  A rolling hash over the
last ``window`` ids cuts the stream of a document into chunks; a chunk is
stored once, under the hash of its bytes, however many documents share it.  A
document is a recipe, the list of its chunks, with the root of the Merkle tree
over their hashes; recipes are written in ascending order of document, each
file of recipes has a root of its own, and the manifest holds the root of all.

Reading back joins recipes and chunks, checks every chunk against its address
and every document against its root, and fails on the first mismatch.

Layout of a store folder (Parquet): ``stored/kind=chunk`` (address, ids),
``recipes`` (doc_id, start, n_tokens, root, chunks), ``manifest`` (part, n_docs,
n_tokens, root).  The ids of a chunk are little-endian, of two bytes where the
vocabulary allows it, in a zstandard frame; the address is the hash of the
bytes before compression.  Chunks lie in buckets by address, so reading back
moves recipes to the chunks and chunk bytes only once, to their documents.

Defined results: a null text is empty and holds only the end id; repeated rows
share one content and keep a recipe each (ties by content hash); a null id comes
first; very long texts have more chunks, a very long word likewise; an empty
table gives an empty store; other columns, whatever their names, are not stored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm import wordcodes
from lexiforge.llm.common import blocks, drop_path, new_path, shuffles_dropped, vocabulary_path

_GEAR = np.random.default_rng(8).integers(0, 2**63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, window: int = 16, mask_bits: int = 9, least: int = 128, most: int = 4096) -> list[int]:
    """Ends of the chunks of an id stream.

    The rolling hash of the ids up to a place is a sum over the last ``window``
    of them, so equal surroundings give equal cuts wherever they stand.  Chunks
    have ``least`` to ``most`` ids, and about ``2**mask_bits`` more than
    ``least`` on average.
    """
    n = len(ids)
    if n <= least:
        return [n]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_GEAR[ids & 0xFFFF] * wordcodes.powers("r", n))])
    w = min(window, n)
    h = (total[w:] - total[:-w]) * wordcodes.powers("i", n)[: n - w + 1]
    h ^= h >> np.uint64(32)
    marks = np.flatnonzero((h & np.uint64((1 << mask_bits) - 1)) == 0) + w
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least or m == n:
            if m > at:
                out.append(m)
            at = m
    return out


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the binary hash tree over ``hashes``; an odd last node moves up."""
    level = [hashlib.blake2b(b"\x00" + h, digest_size=16).digest() for h in hashes] or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def address_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _stored(df: DataFrame, doc_id: str, text: str, end_id: int, vocab: str, width: str, cuts: dict) -> DataFrame:
    """One row per chunk (kind chunk) and document (kind recipe, under an address of its own)."""
    import pyarrow as pa

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        (memo,), squeeze = wordcodes.held((wordcodes.BpeWords, vocab)), zstandard.ZstdCompressor(3).compress
        task, n_docs = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for s, e in blocks([len(t) for t in texts], 1_000_000):
                ids, edges = memo.encode(texts[s:e])
                told, chunk_rows, recipes = set(), ([], []), ([], [], [], [], [])
                for i in range(e - s):
                    own = np.append(ids[edges[i] : edges[i + 1]], np.uint32(end_id))
                    if own.max() > np.iinfo(width).max:
                        raise ValueError(f"id {own.max()} does not fit width {width}")
                    data, ends = own.astype(width), cut_points(own, **cuts)
                    names = []
                    for a, b in zip([0, *ends], ends, strict=False):
                        part = data[a:b].tobytes()
                        name = address_of(part)
                        names.append(name)
                        if name not in told:  # copies within the block need not travel
                            told.add(name)
                            chunk_rows[0].append(name)
                            chunk_rows[1].append(squeeze(part))
                    place = task.to_bytes(6, "big") + n_docs.to_bytes(6, "big")
                    n_docs += 1
                    for col, x in zip(recipes, (place, keys[s + i], len(own), merkle_root(names), names), strict=True):
                        col.append(x)
                n, m = len(chunk_rows[0]), len(recipes[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk_rows[0] + recipes[0], pa.binary()), pa.array(["chunk"] * n + ["recipe"] * m), pa.array(chunk_rows[1] + [None] * m, pa.binary()),
                        pa.array([None] * n + recipes[1], pa.int64()), pa.array([None] * n + recipes[2], pa.int64()), pa.array([None] * n + recipes[3], pa.binary()), pa.array([None] * n + recipes[4], pa.list_(pa.binary())),
                    ],
                    names=["address", "kind", "ids", "doc_id", "n_tokens", "root", "chunks"],
                )

    source = df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string").cast("binary"))
    rows = source.mapInArrow(run, "address binary, kind string, ids binary, doc_id long, n_tokens long, root binary, chunks array<binary>")
    # the partial aggregate folds copies before the exchange
    kept = [F.first(c).alias(c) for c in ("kind", "ids", "doc_id", "n_tokens", "root", "chunks")]
    return rows.groupBy("address").agg(*kept)  # by the address alone, as the buckets are


def _table_of(path: str) -> str:
    return "castore_" + hashlib.md5(path.encode()).hexdigest()


def write_store(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, vocabulary: str | None = None, width: str = "<u2", **cuts) -> None:
    """Encode ``df`` and write the store under ``path`` (a folder all executors share)."""
    import pyarrow as pa

    spark, vocab = df.sparkSession, vocabulary or vocabulary_path("word_bpe_49k.json")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = _stored(df, doc_id, text, end_id, vocab, width, cuts)
    writer = stored.write.format("parquet").option("compression", "zstd").option("path", f"{path}/stored")
    with shuffles_dropped(spark):
        writer.partitionBy("kind").bucketBy(parts, "address").sortBy("address").saveAsTable(_table_of(path))
    recipes = spark.table(_table_of(path)).where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "chunks")

    # ascending documents; where each starts follows from the sizes of the ranges before it
    order = ["doc_id", "root"]
    held = f"{path}/ranges"
    recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(held)
    ranged = spark.read.schema("doc_id long, n_tokens long, root binary, chunks array<binary>, part int").parquet(held)
    sizes = dict(ranged.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row per range
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    before = F.get(F.lit([starts.get(p, 0) for p in range(max(starts, default=0) + 1)]).cast("array<bigint>"), F.col("part"))
    run_up = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    full = ranged.select("part", "doc_id", (before + F.coalesce(F.sum("n_tokens").over(run_up), F.lit(0))).alias("start"), "n_tokens", "root", "chunks")
    full.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/recipes")

    def roots(batches):
        """Root of the documents' roots of each block of a range."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([merkle_root(x) for x in batch.column(4).to_pylist()], pa.binary())],
                names=["part", "block", "n_docs", "n_tokens", "root"],
            )

    block = F.floor((F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1) / 4096)
    folded = ranged.select("part", block.alias("block"), "root", "n_tokens", "doc_id").groupBy("part", "block")
    listed = folded.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
    manifest = listed.select("part", "block", "n_docs", "n_tokens", F.col("x.root").alias("root")).mapInArrow(roots, "part int, block long, n_docs long, n_tokens long, root binary")
    manifest.write.parquet(f"{path}/manifest")
    drop_path(spark, held)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, root, chunks) of every document."""
    return spark.read.schema("doc_id long, start long, n_tokens long, root binary, chunks array<binary>, part int").parquet(f"{path}/recipes").drop("part")


def read_contents(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """(root, ids) of every distinct content, verified; ids are unsigned little-endian 32-bit.

    In the session that wrote the store its bucketed table is used; elsewhere
    the files under ``path``.
    """
    import pyarrow as pa

    known = spark.catalog.tableExists(_table_of(path))
    stored = spark.table(_table_of(path)) if known else spark.read.parquet(f"{path}/stored")
    chunks = stored.where("kind = 'chunk'").select("address", "ids")
    # documents of one content share the work; their roots are equal
    contents = read_recipes(spark, path).groupBy("root").agg(F.first("chunks").alias("chunks"))
    wanted = contents.select("root", F.posexplode("chunks").alias("at", "address"))
    joined = wanted.join(chunks, "address").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "address", "ids"))).alias("x"))

    def rebuild(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            roots, out = batch.column(0).to_pylist(), []
            for root, parts in zip(roots, batch.column(1).to_pylist(), strict=True):
                data = [expand(p["ids"]) for p in parts]
                if merkle_root([p["address"] for p in parts]) != root or any(address_of(d) != p["address"] for d, p in zip(data, parts, strict=True)):
                    raise ValueError("the store does not match its manifest")
                out.append(np.frombuffer(b"".join(data), width).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["root", "ids"])

    return joined.mapInArrow(rebuild, "root binary, ids binary")


def read_store(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document."""
    return read_recipes(spark, path).join(read_contents(spark, path, width), "root").select("doc_id", "start", "n_tokens", "ids")


def new_store(df: DataFrame, **options) -> str:
    """Write a store for ``df`` under the shared folder and return its path."""
    path = new_path(df.sparkSession, "castore")
    write_store(df, path, **options)
    return path
