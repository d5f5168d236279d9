"""The document model as columns: blocks of spans, read from and written to formats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.codecs import blocks as B
from weftline.operators.convert import READ_DOCUMENT, WRITE_DOCUMENT

SPAN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,strike:boolean,href:string>"
BLOCK = f"struct<kind:string,level:int,ordered:boolean,number:int,spans:array<{SPAN}>,text:string,info:string,rows:array<array<array<{SPAN}>>>,has_header:boolean>"


def _run(files: DataFrame, keep: list[str], made: str, each) -> DataFrame:
    """Map rows one to one: ``each(row)`` gives the columns of ``made`` or raises."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = files.sparkSession
    extra = spark.createDataFrame([], made + ", error_code string").schema
    schema = files.select(*keep).schema
    for f in extra:
        schema = schema.add(f)
    arrow, names = to_arrow_schema(schema), [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows.append((*each(r), None))
                except Exception:  # any fault of one file's parser is that row's error
                    rows.append((*[None] * (len(names) - 1), "convert_failed"))
            cols = [b.column(k).cast(arrow.field(k).type) for k in keep]
            cols += [pa.array([r[i] for r in rows], arrow.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return files.mapInArrow(run, schema)


def read_documents(files: DataFrame, key: str, content: str, fmt: str) -> DataFrame:
    """(key, title, lang, blocks, error_code) of files of one document format."""

    def each(r: dict) -> tuple:
        raw = r["__raw"] or b""
        d = READ_DOCUMENT[fmt](raw.encode() if isinstance(raw, str) else raw)
        return d.title, d.lang, [asdict(b) for b in d.blocks]

    few = files.select(key, F.col(content).alias("__raw"))
    return _run(few, [key], f"title string, lang string, blocks array<{BLOCK}>", each)


def write_documents(docs: DataFrame, key: str, fmt: str) -> DataFrame:
    """(key, result, error_code) of (key, title, lang, blocks)."""

    def each(r: dict) -> tuple:
        span = lambda x: [B.Span(**s) for s in x]
        found = [B.Block(**(b | {"spans": span(b["spans"]), "rows": [[span(c) for c in row] for row in b["rows"]]})) for b in r["blocks"] or []]
        return (WRITE_DOCUMENT[fmt](B.Document(found, r["title"] or "", r["lang"] or "")),)

    return _run(docs.select(key, "title", "lang", "blocks"), [key], "result binary", each)


def plain(spans: Column) -> Column:
    """The text of spans."""
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def title_of(title: Column, blocks: Column) -> Column:
    """The given title, else the first heading's text, else the first paragraph's."""
    first = lambda kind: F.get(F.filter(F.transform(F.filter(blocks, lambda b: b["kind"] == kind), lambda b: F.trim(F.regexp_replace(plain(b["spans"]), r"\s+", " "))), lambda t: t != ""), 0)
    return F.coalesce(F.nullif(title, F.lit("")), F.left(F.coalesce(first(B.HEADING), first(B.PARAGRAPH)), F.lit(80)), F.lit("Document"))


def block_rows(docs: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, level, text): one row per block."""
    rows = docs.select(key, F.posexplode("blocks").alias("pos", "b"))
    text = F.when(F.col("b.kind") == B.CODE, F.col("b.text")).when(F.col("b.kind") == B.TABLE, F.array_join(F.transform("b.rows", lambda r: F.array_join(F.transform(r, plain), "\t")), "\n")).otherwise(plain(F.col("b.spans")))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.col("b.kind").alias("kind"), F.col("b.level").alias("level"), text.alias("text"))


def chapters(rows: DataFrame, key: str) -> DataFrame:
    """Adds chapter to block rows: cut at headings of level 1 where there are two or
    more, else 0.  A document's blocks are one window's rows."""
    head = F.when((F.col("kind") == B.HEADING) & (F.col("level") == 1), 1)
    w = W.partitionBy(key)
    n = F.count(head).over(w.orderBy("pos"))
    return rows.withColumn("chapter", F.when(F.count(head).over(w) >= 2, n).otherwise(0))
