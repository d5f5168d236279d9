"""Tables of text cells: delimited, Markdown, HTML and JSON forms, records and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import cell_string, html_escape, is_numeric_cell, markdown_cell, quoted
from weftline.work import numbered


def cells(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A typed row as an array of text cells."""
    kinds = dict(df.dtypes)
    return F.array(*[cell_string(F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns])


def to_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """(row_no, cells): the header is row 0, the others are numbered by ``order``,
    as ``numbered`` does, without a task that sees all rows."""
    spark = df.sparkSession
    keys = [f"_o{i}" for i in range(len(order))]
    parts = df.select(cells(df).alias("cells"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    body = numbered(parts, [], keys, "row_no").select("row_no", "cells")
    head = spark.createDataFrame([(0, list(df.columns))], "row_no long, cells array<string>")
    return head.unionByName(body)


def delimited_line(cells: Column, delimiter: str) -> Column:
    return F.array_join(F.transform(cells, lambda c: quoted(c, delimiter)), delimiter)


def record_names(header: Column) -> Column:
    """Column names of a header: an empty one is colN."""
    return F.transform(header, lambda h, i: F.when(h == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(h))


def json_text(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)


def record_json(names: Column, cells: Column) -> Column:
    """An ordered object of text values; short rows are padded, further cells go."""
    pair = lambda n, i: F.concat(json_text(n), F.lit(":"), json_text(F.coalesce(F.get(cells, i), F.lit(""))))
    return F.concat(F.lit("{"), F.array_join(F.transform(names, pair), ","), F.lit("}"))


def markdown_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def markdown_rule(header: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(header, lambda _: F.lit(" --- ")), "|"), F.lit("|"))


def html_line(cells: Column, tag: str = "td") -> Column:
    each = F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), F.replace(html_escape(c), F.lit("\n"), F.lit("<br>")), F.lit(f"</{tag}>")))
    return F.concat(F.lit("<tr>"), F.array_join(each, ""), F.lit("</tr>"))


def header_union(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(position, name): the columns of JSON objects laid out as a table, in the
    order in which the objects, sorted by ``key``, first bring them; the names of
    one object are sorted."""
    names = docs.select(F.col(key).alias("_k"), F.explode(F.json_object_keys(json)).alias("name"))
    first = names.groupBy("name").agg(F.min("_k").alias("_k"))
    w = W.orderBy("_k", "name")  # one row per distinct column name
    return first.select((F.row_number().over(w) - 1).cast("long").alias("position"), "name")


def long_cells(df: DataFrame, key: str) -> DataFrame:
    """(key, col_no, name, value, numeric): one row per cell."""
    own = [c for c in df.columns if c != key]
    named = F.arrays_zip(F.array(*map(F.lit, own)).alias("name"), cells(df, own).alias("value"))
    out = df.select(F.col(key), F.posexplode(named).alias("col_no", "c"))
    return out.select(key, F.col("col_no").cast("long").alias("col_no"), F.col("c.name").alias("name"), F.col("c.value").alias("value"), is_numeric_cell(F.col("c.value")).alias("numeric"))


def trim_empty(sheets: DataFrame, sheet: str = "sheet", rows: str = "rows") -> DataFrame:
    """Sheets as arrays of rows, without empty rows and columns at their ends and
    padded to one width."""
    filled = F.transform(F.col(rows), lambda r: F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(c != "", i + 1).otherwise(0))), F.lit(0)))
    s = sheets.withColumn("_f", filled)
    s = s.withColumn("_w", F.coalesce(F.array_max("_f"), F.lit(0))).withColumn("_h", F.coalesce(F.array_max(F.transform("_f", lambda n, i: F.when(n > 0, i + 1).otherwise(0))), F.lit(0)))
    width = F.sequence(F.lit(1), F.col("_w"))
    padded = lambda r: F.transform(width, lambda i: F.coalesce(F.get(r, i - 1), F.lit("")))
    kept = F.when(F.col("_h") == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.slice(rows, F.lit(1), F.col("_h")), padded))
    return s.withColumn(rows, kept).drop("_f", "_w", "_h")
