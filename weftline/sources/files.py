"""Files as rows, in and out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.jobs import MAX_INPUT

#: The columns of Spark's binary file source.
BINARY = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]
)


def read_files(spark: SparkSession, path: str, glob: str | None = None, limit: int = MAX_INPUT) -> DataFrame:
    """(path, name, size, content, error_code) of the files under ``path``.

    Content beyond ``limit`` isn't read: the condition on the length is pushed to
    the source, and larger files come as rows with an error and no content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    fit = files.where(F.col("length") <= limit).select("path", name.alias("name"), F.col("length").alias("size"), "content", F.lit(None).cast("string").alias("error_code"))
    large = files.where(F.col("length") > limit).select("path", name.alias("name"), F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("error_code"))
    return fit.unionByName(large)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files under ``path`` as a stream of rows."""
    return spark.readStream.format("binaryFile").schema(BINARY).load(path)


def write_files(files: DataFrame, path: str, name: str = "output", content: str = "result") -> DataFrame:
    """Write each row's content to ``path``/name from the executors, and return
    (name, size, error_code).

    Rows are written to a hidden file and renamed, so a task that runs twice leaves
    one whole file.  Names must be relative; ``path`` is a folder that executors
    share, or a URI of a store that Arrow's file systems open (file, hdfs, s3, gs)."""
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for b in batches:
            codes, sizes = [], []
            names = b.column(0).to_pylist()
            for n, raw in zip(names, b.column(1).to_pylist(), strict=True):
                code = None
                try:
                    if not n or raw is None or n.startswith("/") or ".." in n.split("/"):
                        raise OSError("no name or content")
                    folder, _, last = f"{root.rstrip('/')}/{n}".rpartition("/")
                    store.create_dir(folder, recursive=True)
                    hidden = f"{folder}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(hidden) as f:
                        f.write(raw)
                    store.move(hidden, f"{folder}/{last}")
                except OSError:
                    code = "write_failed"
                codes.append(code)
                sizes.append(None if raw is None else len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(codes, pa.string())], ["name", "size", "error_code"])

    return files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, size long, error_code string")
