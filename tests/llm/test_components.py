import random

import pytest

from weftline.llm.common import labelled_sample, sized, work_path
from weftline.llm.components import components


def plain(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(8)
    edges = {
        "chain": [(i + 1, i) for i in range(150)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (5, 5), (7, None)],
        "star": [(0, i) for i in range(1, 200)] + [(200, i) for i in range(201, 230)],
        "empty": [],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == plain(edges)


def test_shared_folder_is_the_session_s(spark):
    path = work_path(spark, "x")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert path.startswith(base.rstrip("/") + "/x-") and work_path(spark, "x") != path


def test_sizes_are_checked_before_broadcast(spark, monkeypatch):
    from weftline.llm import common

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    ids = spark.range(100)
    assert "broadcast" in plan(sized(ids, "ids")).lower()
    monkeypatch.setattr(common, "FEW", 10)
    assert "broadcast" not in plan(sized(ids, "ids")).lower()


def test_sample_is_bounded_and_skips_held_out(spark, docs_of):
    docs = docs_of([(i, "t" * (i % 7), "s") for i in range(200)]).selectExpr("doc_id as _id", "text as _t")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, y int")
    import zlib

    got = labelled_sample(docs, labels, "doc_id", "y", 50, 5)
    assert 0 < len(got) <= 50 and all(len(t) <= 5 for _, t, _ in got) and got == sorted(got)
    every = labelled_sample(docs, labels, "doc_id", "y", 10_000, 10)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))


@pytest.mark.parametrize("kind", ["chain", "random", "star", "repeated", "empty"])
def test_few_edges_and_many(spark, kind, monkeypatch):
    from weftline.llm import components as C

    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(0, 600, 2)] + [(i + 1, i) for i in range(599, 0, -2)],
        "random": [(rng.randrange(-900, 2**62, 10**16), rng.randrange(400)) for _ in range(500)] + [(None, 1), (5, 5), (7, None)],
        "star": [(10**9, i) for i in range(1, 300)],
        "repeated": [(3, 2), (2, 3), (3, 2), (9, 9)] * 40,
        "empty": [],
    }[kind]
    df = spark.createDataFrame(edges, "u long, v long")
    for most in (C.FEW_EDGES, len(edges), 0):
        monkeypatch.setattr(C, "FEW_EDGES", most)
        got = [(r.node, r.component) for r in components(df).collect()]
        assert len(got) == len(dict(got)) and dict(got) == plain(edges)


def test_few_edges_take_few_jobs(spark):
    """On skewed input with 211 shuffle partitions, rounds of shuffles took a third of op1's time."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(150)], "u long, v long")
    spark.sparkContext.setJobGroup("few-edges", "components")
    try:
        assert {r.component for r in components(edges).collect()} == {0}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) <= 3
