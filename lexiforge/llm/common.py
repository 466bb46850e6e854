"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (the same on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent a temporary folder is made and set as the
    checkpoint directory, but only for a session of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiforge-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a write go when it has ended; what it wrote is the only copy needed."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage: what follows never recomputes ``df``, whichever
    executor is lost.
    """
    return Scratch(df.sparkSession).put(df, label, codec)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables in the shared folder, dropped by name once all that reads them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        path = new_path(self.spark, label)
        with shuffles_dropped(self.spark):
            df.write.option("compression", codec).parquet(path)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            for path in self.paths.pop(label, ()):
                drop_path(self.spark, path)


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive runs of about ``limit`` bytes (one row at least)."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def columns_of(df: DataFrame) -> list:
    """All columns by name, whatever characters the names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def own_prefix(df: DataFrame) -> str:
    """A prefix for working columns that no column of ``df`` begins with."""
    return "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """``df`` with every named column present, absent ones as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def worker_env() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def map_texts(df: DataFrame, make, fields: str, text: str = "text", keep: list[str] | None = None, also: tuple[str, ...] = (), block_bytes: int = 1_000_000) -> DataFrame:
    """Add ``fields`` (DDL), computed from whole texts in Arrow blocks.

    ``make()`` runs once per task and returns a function from a list of texts
    (bytes, or None for null), and of each column named in ``also``, to a dict
    of columns.  ``keep`` names the columns carried along (all by default); one
    that clashes with a new field gives way.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    source = df.select(
        *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept)],  # no name of the caller's can clash
        *[F.col(f"`{c}`").alias(f"also_{i}") for i, c in enumerate(also)],
        F.col(f"`{text}`").cast("string").cast("binary").alias("read"),
    )
    schema = StructType([*source.schema.fields[: len(kept)], *[StructField(f.name, f.dataType) for f in added]])
    types = {f.name: t.type for f, t in zip(added, to_arrow_schema(added), strict=True)}

    def run(batches):
        f = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            more = [batch.column(len(kept) + i).to_pylist() for i in range(len(also))]
            for s, e in blocks([len(t) if t else 0 for t in texts], block_bytes):
                new = f(texts[s:e], *[m[s:e] for m in more])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(s, e - s) for i in range(len(kept))), *(pa.array(new[n], types[n], from_pandas=False) for n in types)],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema).toDF(*kept, *added.names)
