"""Numbers over ranges, the shared folder, and routes without failed edges."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import jobs as J
from weftline.operators import rows as R
from weftline.plans.planner import routes, routes_without
from weftline.work import numbered, work_path


@pytest.fixture
def many_ranges(spark):
    """Hundreds of ranges, which adaptive execution merges by their tiny target size."""
    keys = {"spark.sql.shuffle.partitions": "300", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_rows_of_a_wide_table(many_ranges):
    n = 30_000
    d = many_ranges.range(n).select((F.col("id") * 7919 % n).alias("k"), *[F.concat(F.lit("wide" * 20), F.col("id") % 97).alias(f"c{i}") for i in range(6)])
    got = R.to_rows(d, ["k"])
    want = d.select((F.row_number().over(W.orderBy("k"))).cast("long").alias("row_no"), R.cells(d).alias("cells"))
    assert got.count() == n + 1
    assert got.where("row_no > 0").exceptAll(want).count() == 0 and got.where("row_no = 0").head().cells == d.columns
    assert got.agg(F.countDistinct("row_no")).head()[0] == n + 1


def test_numbers_within_keys(many_ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(50)}"]), i) for i in range(20_000)]
    d = many_ranges.createDataFrame(rows, "k string, v long")
    want = d.withColumn("_rank", F.row_number().over(W.partitionBy("k").orderBy("v")).cast("long"))
    got = numbered(d, ["k"], ["v"])
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert numbered(d.limit(0), ["k"], ["v"]).count() == 0


def test_a_hot_name_in_an_archive(many_ranges):
    d = many_ranges.range(5000).select(F.lit("a").alias("archive"), F.lit("x/same.txt").alias("name"), "id")
    got = {r.id: r.entry for r in J.pack_names(d, "archive", "name", "id").collect()}
    assert got == {i: "same.txt" if i == 0 else f"same-{i + 1}.txt" for i in range(5000)}


def test_work_path(spark):
    path = work_path(spark, "x")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert path.startswith(base.rstrip("/") + "/x-") and work_path(spark, "x") != path


def test_routes_without_several_edges(spark):
    edges = ["docx>pdf@office", "png>pdf@", "mp4>mp3@ffmpeg"]
    got = {(r.without, r.src, r.dst): (r.cost, r["keys"]) for r in routes_without(spark, edges).collect()}
    want = {(e, r.src, r.dst): (r.cost, r["keys"]) for e in edges for r in routes(spark, excluding=[e]).collect()}
    assert got == want
    assert routes_without(spark, []).count() == 0
