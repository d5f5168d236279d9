import hashlib
import random

import numpy as np
import pytest

from weftline.llm import exact_dedup as X


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    raw = X.fuse_build(keys)
    assert X.fuse_contains(raw, keys).all()
    others = np.setdiff1d(rng.integers(0, 2**64, 20_000, dtype=np.uint64), keys)
    assert X.fuse_contains(raw, others).mean() < 0.002
    if n >= 50_000:
        assert len(raw) < 2.6 * n  # 16 bits a key and an eighth more


def plain(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, len(t or "")))
    out = {}
    for k, g in groups.items():
        best = min(g, key=lambda x: (-x[1], x[0]))
        for i, _ in g:
            out[i] = (best[0], len(g), i == best[0], hashlib.sha256(k.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", ["pmod(xxhash64(_id), 2) = 0", "true", "false", "_id < 40"])
def test_equal_brute_force(docs_of, part):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "a  b", "ab\n", "x", "", None, "é ", "é", f"own {i}", "hot " * rng.randrange(1, 3)])) for i in range(200)]
    got = X.exact_duplicates(docs_of(rows), in_snapshot=part).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == plain(rows)


def test_odd_rows_and_keeping(clashing, odd_rows):
    decided = X.exact_duplicates(clashing)
    got = decided.collect()
    assert len(got) == len(odd_rows) and sum(r.kept for r in got) == 6
    kept = X.keep_first(clashing, decided)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 6, 7, 8, None]


def test_repeated_ids_are_told_apart(docs_of):
    d = docs_of([(1, "a"), (1, "b"), (1, "a"), (0, "b"), (2, "c")])
    kept = X.keep_first(d, X.exact_duplicates(d)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, "b"), (1, "a"), (2, "c")]
    assert X.exact_duplicates(docs_of([])).count() == 0



def test_two_snapshots_and_a_batch(spark, docs_of, tmp_path):
    rng = random.Random(4)
    texts = ["a b", "ab ", "a  b", "x", "", None, "é", "own", *(f"text {k}" for k in range(30))]
    parts = [[(100 * p + i, rng.choice(texts)) for i in range(60)] for p in range(3)]
    for i in range(2):
        X.write_snapshot(docs_of(parts[i]), f"file://{tmp_path}/s{i}")
    snapshots = [X.load_snapshot(spark, f"file://{tmp_path}/s{i}") for i in range(2)]
    got = X.against_snapshots(docs_of(parts[2]), snapshots).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == plain(sum(parts, []))
    assert {r.doc_id: r.snapshot for r in got} == {i: p if p < 2 else None for p in range(3) for i, _ in parts[p]}
    alone = X.against_snapshots(docs_of(parts[2]), []).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in alone} == plain(parts[2])


def test_equal_digests_of_other_bytes_stay_apart(spark, docs_of, tmp_path, monkeypatch):
    """A snapshot whose row under a digest has other bytes than the batch's."""
    from pyspark.sql import functions as F

    s = X.write_snapshot(docs_of([(1, "one"), (2, "two")]), f"file://{tmp_path}/s")
    forged = s.rows.withColumn("plain", F.when(F.col("_id") == 1, F.lit(b"other")).otherwise(F.col("plain")))
    got = {(r.doc_id, r.snapshot): (r.keep_id, r.group_size, r.kept) for r in X.against_snapshots(docs_of([(3, "one"), (4, "two ")]), [X.Snapshot(forged, s.groups, s.filters, s.buckets)]).collect()}
    assert got[1, 0] == (1, 1, True) and got[3, None] == (3, 1, True)
    assert got[2, 0] == (4, 2, False) and got[4, None] == (4, 2, True)


def test_columns_with_own_names(docs_of):
    from pyspark.sql import functions as F

    d = docs_of([(1, "a"), (1, "b"), (1, "a"), (0, "b"), (2, "c"), (3, "c")])
    for c in ("__sha", "__n", "__other", "__several", "__id", "__of", "__points", "__drop"):
        d = d.withColumn(c, F.lit(7))
    kept = X.keep_first(d, X.exact_duplicates(d))
    assert kept.columns == d.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "b"), (1, "a"), (2, "c")]
