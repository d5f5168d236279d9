"""Helpers that all training-data operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.work import materialise, work_path

__all__ = ["bound_batches", "discard", "few", "fresh", "held_out", "id_and_text", "labelled_sample", "map_text", "materialise", "per_worker", "sized", "table", "texts_of", "work_path"]

#: Rows and bytes of one Arrow batch.  Texts can be very long, so the default of
#: 10,000 rows would let one batch outgrow a Python worker; a batch is held several
#: times (as bytes, strings and results, and by the JVM's buffers).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES.  They stay
    lowered: results are lazy, and Spark reads the limits when a result is planned."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = "".join(c for c in (spark.conf.get(key, None) or "") if c.isdigit() or c == "-")
        if not now or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


#: Rows of ids (8 bytes each, or 16 of two) that are broadcast at most.
FEW = 1_000_000


def few(written: DataFrame) -> bool:
    """Whether a written frame is small enough to be broadcast."""
    return written.count() <= FEW


def sized(keys: DataFrame, name: str) -> DataFrame:
    """Materialised keys for a join: broadcast if their count is at most FEW, so
    that the other side's texts stay where they are; left to a shuffle beyond."""
    keys = materialise(keys, name)
    return F.broadcast(keys) if few(keys) else keys


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames which nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def per_worker(key: tuple, make: Callable):
    """An object that a Python worker keeps between its tasks: the last one asked for
    only, so that a worker which goes on to another operator gives the memory back."""
    kept = sys.modules.setdefault("_weftline_worker", types.ModuleType("_weftline_worker")).__dict__
    if kept.get("key") != key:
        kept.pop("value", None)
        kept["value"], kept["key"] = make(), key
    return kept["value"]


def texts_of(batch: pa.RecordBatch, column: str | int = "_t") -> list[str]:
    """The column's strings, nulls as empty ones."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_text(df: DataFrame, fn, schema: str, keep: list[str]) -> DataFrame:
    """Map the text column ``_t`` with ``fn(list[str]) -> dict[name, values]`` in
    Arrow batches; the columns in ``keep`` pass through, the text doesn't."""
    out = df.sparkSession.createDataFrame([], schema).schema
    kept = df.select(*keep).schema

    full = type(out)(kept.fields + out.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(texts_of(batch))
            cols = [batch.column(k) for k in keep]
            cols += [pa.array(made[f.name], arrow.field(f.name).type) for f in out.fields]
            yield pa.RecordBatch.from_arrays(
                [c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, arrow, strict=True)],
                schema=arrow,
            )

    return df.mapInArrow(run, full)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under names of its own, so
    that further columns of the input can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))


def held_out(id_col: str) -> "F.Column":
    """Whether a row is kept from learning: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int, chars: int) -> list[tuple[int, str, int]]:
    """(id, text, label), by id, of at most ``rows`` labelled rows for the driver to learn from:
    those with the smallest hash of the id that aren't held out, without texts of
    more than ``chars`` characters.  The ids are chosen first, so only the chosen
    texts are moved."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(~held_out("_id") & F.col("_y").isNotNull() & F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.where(F.length("_t") <= chars).join(F.broadcast(known), "_id").groupBy("_id").agg(F.max("_t").alias("_t"), F.max("_y").alias("_y"))
    return sorted((r["_id"], r["_t"], r["_y"]) for r in found.collect())
