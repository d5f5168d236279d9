"""Conversion of files as they arrive, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weftline.operators.run import Routes, planned_routes, run_files
from weftline.sources.files import read_stream


def convert_batch(files: DataFrame, target: str, plan: Routes | None = None) -> DataFrame:
    """(path, modified, output, result, error_code, detail) of (path,
    modificationTime, length, content) rows, by built-in steps only."""
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]*)\z", 1))
    made = run_files(named, target, size="length", plan=plan)
    return made.select("path", F.col("modificationTime").alias("modified"), "output", "result", "error_code", "detail")


def convert_stream(spark, source: str, sink: str, checkpoint: str, target: str) -> StreamingQuery:
    """Convert what arrives under ``source`` into Parquet rows under ``sink``.

    Each micro-batch replaces its own folder, batch=<id>, so one that is run again
    after a failure leaves its rows once; the stream's checkpoint keeps which files
    it has seen."""

    plan = planned_routes(spark, target)

    def write(batch: DataFrame, number: int) -> None:
        convert_batch(batch, target, plan).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return read_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
