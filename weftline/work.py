"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: that of spark.checkpoint.dir, or else of the
    context.  Where neither is set, one machine alone gets a temporary folder; on a
    cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, and what an executor loses later is read again, not computed again."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "_rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... by ``order`` within equal ``keys``, nulls being
    equal.

    The rows are dealt by ranges of keys and order, sorted apart and written once; a
    range's numbers come from the counts of the ranges before it.  So no task sees
    all rows of a key, and both uses of the numbers read the same files: ranges
    that were dealt twice need not have the same bounds."""
    parts = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    written = materialise(parts.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    written = written.withColumn("__part", F.shiftright("__at", 33))
    counts = written.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range and key
    counts = counts.select(
        F.col("__part").alias("__p"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before")
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    joined = written.join(counts if keys else F.broadcast(counts), same)  # without keys, a row a range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name))
