"""Where intermediate and stored tables live, and numbering rows across partitions."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a temporary one on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lexiforge-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def put(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; what follows never recomputes it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files come in fewer pieces (one large row group); unchanged otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def constant_array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with each row's place in ``order``, without ever sorting all rows in one task.

    Rows are sorted in ranges and written with their place in their range; the
    sizes of the ranges (one number each) give what comes before.
    """
    place = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    ranged = put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "ranges")
    part = F.shiftright("__at", 33)
    before, sizes = start, dict(ranged.groupBy(part.alias("part")).count().collect())
    offsets = []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, F.get(constant_array(offsets), part.cast("int")) + row).drop("__at")
