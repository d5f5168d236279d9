"""Exact deduplication of a new batch against immutable snapshots.

A snapshot is a folder: its rows with their normalised texts, one group row per
distinct text, dealt into buckets by digest, and per bucket a static 3-wise binary
fuse filter over its digests.  It is written once and loaded for every later batch.
A batch is grouped by digest on its own; its groups are screened bucket by bucket
against each snapshot's filters; only positives are joined to that snapshot's exact
buckets, where the normalised bytes of the two representatives are compared.  Texts
move only for that comparison.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, fresh, id_and_text, map_text, materialise, sized, work_path

#: Digests a filter holds on average: a bucket's keys are one task's memory.
KEYS_PER_BUCKET = 1 << 17
FILTER_HEAD = "<QIIQ"


def normalise(text: str) -> bytes:
    """The text in UTF-8 without ``[\\x20\\x09-\\x0D]``: what bytes.split drops."""
    return b"".join(text.encode("utf-8", "surrogatepass").split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(h: np.ndarray, length: int, span: int) -> np.ndarray:
    """The three slots of each hash, one in each of three adjacent segments."""
    mask = np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint16)


def fuse_build(keys: np.ndarray) -> bytes:
    """A binary fuse filter with 16-bit fingerprints over distinct 64-bit keys.

    Peeling runs in rounds: all slots of one remaining key give up their keys at
    once.  Slots that a round frees aren't touched by its other keys, so values are
    set a round at a time too, from the last round to the first."""
    n = len(keys)
    length = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / length) - 2)
    span, size = segments * length, (segments + 2) * length
    for seed in range(1, 200):
        h = _mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        at = _places(h, length, span)
        count = np.bincount(at.ravel(), minlength=size)
        which = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(which, row, np.arange(n))
        rounds, left = [], n
        while left:
            slots = np.flatnonzero(count == 1)
            if not len(slots):
                break
            peeled, first = np.unique(which[slots], return_index=True)
            rounds.append((peeled, slots[first]))
            left -= len(peeled)
            for row in at[:, peeled]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, peeled)
        if left:
            continue
        table, prints = np.zeros(size, np.uint16), _prints(h)
        for peeled, slots in reversed(rounds):
            table[slots] = 0
            a, b, c = at[:, peeled]
            table[slots] = prints[peeled] ^ table[a] ^ table[b] ^ table[c]
        return struct.pack(FILTER_HEAD, seed, length, span, n) + table.tobytes()
    raise RuntimeError("no seed gave a filter; are the keys distinct?")


def fuse_contains(raw: bytes, keys: np.ndarray) -> np.ndarray:
    seed, length, span, n = struct.unpack_from(FILTER_HEAD, raw)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(raw, np.uint16, offset=struct.calcsize(FILTER_HEAD))
    h = _mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    a, b, c = _places(h, length, span)
    return _prints(h) == table[a] ^ table[b] ^ table[c]


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), "<u8")


def digests(docs: DataFrame) -> DataFrame:
    """(_id, n_points, digest, plain, row) of (_id, _t); a null text counts as empty.
    ``row`` numbers the rows; it holds once they are written."""

    def run(texts: list[str]) -> dict[str, list]:
        plain = [normalise(t) for t in texts]
        return {"n_points": list(map(len, texts)), "digest": [hashlib.sha256(p).digest() for p in plain], "plain": plain}

    return map_text(docs, run, "n_points long, digest binary, plain binary", ["_id"]).withColumn("row", F.monotonically_increasing_id())


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per digest.  ``best`` orders rows by code points, then smallest id
    (its complement is largest), then row number; nulls come last."""
    best = F.struct("n_points", F.bitwise_not("_id").alias("not_id"), F.bitwise_not("row").alias("not_row"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("size"), F.max(best).alias("best"))
    return groups.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "*")


@dataclass(frozen=True)
class Snapshot:
    """rows (_id, n_points, digest, plain, row), groups (bucket, digest, size, best),
    filters (bucket, filter), as written."""

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    rows, groups, filters = (spark.read.parquet(f"{path}/{x}") for x in ("rows", "groups", "filters"))
    return Snapshot(rows, groups, filters, spark.read.json(f"{path}/about", schema="buckets int").head()[0])


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Write a snapshot of all rows of ``docs`` to the folder ``path``, which must not
    hold one yet, and load it."""
    spark = docs.sparkSession
    bound_batches(spark)
    digests(id_and_text(docs, id_col, text_col)).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    buckets = max(1, math.ceil(rows.count() / KEYS_PER_BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def build(t: pa.Table) -> pa.Table:
        raw = fuse_build(np.unique(_keys(t.column("digest"))))
        return pa.table({"bucket": t.column("bucket")[:1], "filter": pa.array([raw], pa.binary())})

    _grouped(rows, buckets).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    groups.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary").write.parquet(f"{path}/filters")
    spark.createDataFrame([(buckets,)], "buckets int").write.json(f"{path}/about")
    return load_snapshot(spark, path)


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """The groups (bucket, digest, row) whose digest may be in the snapshot."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0)
        return left.filter(pa.array(fuse_contains(right.column("filter")[0].as_py(), _keys(left.column("digest")))))

    return groups.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, groups.schema)


def _differing(batch_rows: DataFrame, groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests of batch groups (bucket, digest, row) that stand in the snapshot with
    other normalised bytes."""
    positives = screen(groups, snapshot.filters)
    old = snapshot.groups.select("bucket", "digest", F.bitwise_not("best.not_row").alias("old_row"))
    pairs = materialise(positives.join(old, ["bucket", "digest"]).select("digest", "row", "old_row"), "pairs")
    few = lambda c: sized(pairs.select(F.col(c).alias("row")), c)
    new = batch_rows.select("row", F.col("plain").alias("new")).join(few("row"), "row", "left_semi")
    known = snapshot.rows.select(F.col("row"), F.col("plain").alias("old")).join(few("old_row"), "row", "left_semi")
    both = pairs.join(new, "row").join(known.withColumnRenamed("row", "old_row"), "old_row")
    return both.where("new <> old").select("digest")


def against_snapshots(batch: DataFrame, snapshots: Sequence[Snapshot], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_points, snapshot), a row per
    row of ``batch`` and of the snapshots; ``snapshot`` is the place of the row's one in
    ``snapshots``, null for the batch.

    Of equal texts the row with most code points stays, then the smallest doc_id, then
    that of the earliest snapshot, the batch last, then one of the rows that repeat it.
    The snapshots aren't changed: write the rows that stay as a new one."""
    spark = batch.sparkSession
    bound_batches(spark)
    rows = materialise(digests(id_and_text(batch, id_col, text_col)), "digests")
    own = materialise(_grouped(rows, max([1, *(s.buckets for s in snapshots)])), "batch")
    found = None
    for s in snapshots:
        few = own.select(F.pmod(F.xxhash64("digest"), F.lit(s.buckets)).cast("int").alias("bucket"), "digest", F.bitwise_not("best.not_row").alias("row"))
        one = _differing(rows, few, s)
        found = one if found is None else found.unionByName(one)
    differing = materialise(found.distinct(), "differing") if found is not None else None

    def variant(df: DataFrame, new: bool) -> DataFrame:
        """``variant`` keeps apart batch texts that share a digest but not bytes."""
        if not new or differing is None:
            return df.withColumn("variant", F.lit(0))
        there = differing.select("digest", F.lit(1).alias("there"))
        return df.join(there, "digest", "left").withColumn("variant", F.coalesce("there", F.lit(0))).drop("there")

    def of(place: int, df: DataFrame) -> DataFrame:
        return variant(df, place == len(snapshots)).withColumn("place", F.lit(place))

    merged, every = None, None
    for i, (g, r) in enumerate([*((s.groups, s.rows) for s in snapshots), (own, rows)]):
        best = F.struct("best.n_points", "best.not_id", F.bitwise_not("place").alias("not_place"), "best.not_row").alias("best")
        g = of(i, g).select("digest", "variant", "size", best)
        r = of(i, r.select("_id", "n_points", "digest", "row"))
        merged, every = (g, r) if merged is None else (merged.unionByName(g), every.unionByName(r))
    merged = merged.groupBy("digest", "variant").agg(F.sum("size").alias("group_size"), F.max("best").alias("best"))
    # Written first: a join of two scans can be split at a digest with many rows, one on an aggregate can't.
    out = every.join(materialise(merged, "groups"), ["digest", "variant"])
    return out.select(
        F.col("_id").alias("doc_id"),
        F.bitwise_not("best.not_id").alias("keep_id"),
        "group_size",
        ((F.col("row") == F.bitwise_not("best.not_row")) & (F.col("place") == F.bitwise_not("best.not_place"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
        F.when(F.col("place") < len(snapshots), F.col("place")).alias("snapshot"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_snapshot: str | Column = "pmod(xxhash64(_id), 2) = 0") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_points), a row per input row.

    ``in_snapshot`` is the condition on ``_id`` of rows that form a snapshot, written
    to the shared folder; the others are a batch that comes later.  Of equal texts the
    row with most code points stays, then the smallest doc_id, then one of the rows
    that repeat it; rows with a null doc_id lose to others and belong to the batch.
    Null and empty texts and texts of white space are equal.  Further columns are
    ignored, and an empty table gives an empty result."""
    bound_batches(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col)
    old = F.coalesce(F.expr(in_snapshot) if isinstance(in_snapshot, str) else in_snapshot, F.lit(False))
    snapshot = write_snapshot(docs.where(old), work_path(docs.sparkSession, "snapshot"), "_id", "_t")
    return against_snapshots(docs.where(~old), [snapshot], "_id", "_t").drop("snapshot")


def keep_first(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, each once, with all their columns.

    A doc_id that stands in one row is decided by it alone; the rows of a repeated
    doc_id are told apart by digest and code points."""
    other_c, several_c, sha, n, key, of, points = fresh(docs, "other", "several", "sha", "n", "id", "of", "points")
    ids = decided.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("any"))
    other = sized(ids.where("n > 1 or not any").select(F.col("doc_id").alias(other_c)), "other")
    single = docs.join(other, F.col(id_col).eqNullSafe(F.col(other_c)), "left_anti")
    several = sized(ids.where("n > 1 and any").select(F.col("doc_id").alias(several_c)), "several")
    again = docs.join(several, F.col(id_col).eqNullSafe(F.col(several_c)), "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    again = again.withColumn(sha, F.sha2(F.regexp_replace(text, "[ \\t-\\r]+", "").cast("binary"), 256)).withColumn(n, F.length(text))
    stays = decided.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(of), F.col("n_points").alias(points))
    match = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(of)) & (F.col(n) == F.col(points))
    again = again.join(stays, match, "left_semi").dropDuplicates([id_col, sha, n]).drop(sha, n)
    return single.unionByName(again)
