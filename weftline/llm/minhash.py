"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian
pruning of their signatures, and exact verification on full shingle sets.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes).
   Documents with equal sets form a class, of which one representative goes on.
2. 128 MinHash values in 32 bands of 4 rows give buckets.  A pair of similarity
   0.75 shares no bucket with probability (1 - 0.75**4)**32 = 5e-6.
3. Each bucket pairs its members with its smallest member only (a star).  The
   signatures of a pair are compared in batches of 32; after each batch the pair
   is given up once the posterior probability of a similarity of 0.75 or more,
   under a uniform prior, is below ``miss``.
4. Survivors are verified on the full sets, recomputed from the whole texts, and
   the links give components.
5. Buckets whose members, without the smallest, are then still in several
   components are taken again, in blocks bounded by rows and by shingles: members
   outside a bucket's main component meet all its members.  A block prunes its pairs
   by signature as above, each pair in the first bucket that its documents share;
   only members of a pair that is left bring their full sets to the block, where
   the pairs are verified.  So no link is lost to the star, no pair becomes a row,
   and a set moves only where it is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, few, fresh, id_and_text, map_text, materialise, sized
from .components import components

WIDTH, BANDS, ROWS, BATCH = 5, 32, 4, 32
K = BANDS * ROWS
#: Rows and shingles a side, on average, of a block in which buckets are compared.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_rng = np.random.default_rng(20240501)
_STEP = _rng.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, K, dtype=np.uint32)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: exactly what the
    methods of ``bytes`` do, which know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer
    words has one shingle, a text without words none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=width)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - width + 1
    s = h[:n] * _STEP[0]
    for i in range(1, width):
        s += h[i : i + n] * _STEP[i]
    return np.unique(_mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    """K MinHash values (32 bits) of a non-empty set."""
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def sketch(texts: list[str]) -> dict[str, list]:
    """Set size and, for texts with words, the key of the set, the signature's bytes
    and the bands' keys."""
    out: dict[str, list] = {"n": [], "set_key": [], "sig": [], "bands": []}
    for t in texts:
        s = shingle_set(t)
        out["n"].append(len(s))
        if not len(s):
            for k in ("set_key", "sig", "bands"):
                out[k].append(None)
            continue
        m = signature(s)
        b = _mix((m.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()))
        out["sig"].append((m & np.uint32(0xFF)).astype(np.uint8).tobytes())
        out["bands"].append(b.view(np.int64))
    return out


def least_matches(threshold: float, miss: float, batch: int = BATCH, k: int = K) -> list[tuple[int, int]]:
    """(n, m) for each batch end n: a pair with fewer than m equal values of the
    first n has a posterior below ``miss`` of being as similar as ``threshold``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail
    beyond t is the probability of at most m successes in n + 1 trials of t."""
    found = []
    for n in range(batch, k + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        found.append((n, m))
    return found


def _prune(threshold: float, miss: float):
    bounds = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb"))
            left, equal, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int32), 0
            for n, m in bounds:  # bits other than the low eight are dropped, so equal counts are never too low
                equal[left] += (x[left, done:n] == y[left, done:n]).sum(axis=1)
                left, done = left[equal[left] >= m], n
            yield pa.RecordBatch.from_arrays(
                [b.column("a").take(pa.array(left)), b.column("b").take(pa.array(left)), pa.array(equal[left])], ["a", "b", "equal"]
            )

    return run


def _verify(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
                if ta != last or of_last is None:  # rows come sorted by a
                    last, of_last = ta, shingle_set(ta or "")
                other = shingle_set(tb or "")
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                if both and 100 * both >= threshold_pct * (len(of_last) + len(other) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return run


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold_pct: int, miss: float) -> DataFrame:
    """The pairs (a, b) of representatives that are links."""
    sig = reps.select("node", "sig")
    known = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"
    )
    likely = materialise(known.mapInArrow(_prune(threshold_pct / 100, miss), "a long, b long, equal int"), "likely")
    pairs, near = likely.select("a", "b"), F.broadcast if few(likely) else lambda df: df
    # Few pairs go to the texts of b, which then move once, to that of a.
    full = docs.select(F.col("_id").alias("b"), F.col("_t").alias("tb")).join(near(pairs), "b")
    hubs = docs.select(F.col("_id").alias("a"), F.col("_t").alias("ta")).join(near(pairs.select("a").distinct()), "a", "left_semi")
    return full.join(hubs, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(threshold_pct), "a long, b long").distinct()


def _likely(t: pa.Table, threshold_pct: int, bounds: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(left row, right rows) of a block's pairs that the signatures leave.

    A pair is of two components and of sizes that allow the threshold; two members
    outside the main component are a pair once, with the smaller left; and a pair
    that shares the bucket of an earlier band belongs to that one."""
    side, node, comp, main = (t.column(c).to_numpy() for c in ("side", "node", "comp", "main"))
    n = t.column("n").to_numpy().astype(np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, K)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    band = int(t.column("band")[0].as_py())
    outside = comp[right] != main[right]
    for i in left:
        fits = (100 * np.minimum(n[right], n[i]) >= threshold_pct * np.maximum(n[right], n[i])) & (comp[right] != comp[i])
        at = right[fits & (~outside | (node[right] > node[i]))]
        equal, done = np.zeros(len(at), np.int32), 0
        for upto, least in bounds:  # bits other than the low eight are dropped, so equal counts are never too low
            equal += (sig[at, done:upto] == sig[i, done:upto]).sum(axis=1)
            stay = equal >= least
            at, equal, done = at[stay], equal[stay], upto
        if band and len(at):
            at = at[~(bands[at, :band] == bands[i, :band]).any(axis=1)]
        if len(at):
            yield int(i), at


def _wanted(threshold_pct: int, miss: float):
    """The members of a block that are in a pair which the signatures leave."""
    bounds = least_matches(threshold_pct / 100, miss)

    def run(t: pa.Table) -> pa.Table:
        need = np.zeros(t.num_rows, bool)
        for i, at in _likely(t, threshold_pct, bounds):
            need[i] = True
            need[at] = True
        return t.filter(pa.array(need))

    return run


def _block(threshold_pct: int, miss: float):
    """Links of a block, verified on full sets: per left member one for each component
    on the right, which is all that components need."""
    bounds = least_matches(threshold_pct / 100, miss)

    def run(t: pa.Table) -> pa.Table:
        node, comp = (t.column(c).to_numpy() for c in ("node", "comp"))
        sets = t.column("s").combine_chunks()
        ends = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        values, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        of = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        mark = np.zeros(len(values), np.uint32)
        a, b = [], []
        for i, at in _likely(t, threshold_pct, bounds):
            mark[of[i]] = 1
            met: set[int] = set()
            for j in at:
                if comp[j] in met:
                    continue
                both = int(mark[of[j]].sum())
                if 100 * both >= threshold_pct * (len(of[i]) + len(of[j]) - both):
                    met.add(comp[j])
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
            mark[of[i]] = 0
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _block_links(members: DataFrame, reps: DataFrame, docs: DataFrame, threshold_pct: int, miss: float) -> DataFrame:
    """Links across components in buckets, (key, band, node, comp), without a row per pair.

    Members outside a bucket's largest component (left) meet all its members
    (right) in blocks of about BLOCK rows and BLOCK_SHINGLES shingles a side, each a
    group of its own.  Only representatives with a mixed bucket bring their
    signature, only those of a pair that it leaves their set."""

    def emit(texts: list[str]) -> dict[str, list]:
        return {"s": [shingle_set(t).view(np.int64) for t in texts]}

    sketch = reps.select("node", "n", "sig", "bands")
    members = materialise(members.join(sketch, "node"), "members")
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    top = F.max(F.struct("rows", "size", "comp")).alias("top")
    per = sizes.groupBy("key").agg(top, F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    count = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    per = per.select(
        "key",
        F.col("top.comp").alias("main"),
        count(F.col("rows") - F.col("top.rows"), F.col("size") - F.col("top.size")).alias("nl"),
        count(F.col("rows"), F.col("size")).alias("nr"),
    )
    # Written first, like the hubs, so that the join can be split at a full bucket.
    m = members.join(materialise(per, "blocks"), "key")
    spread = F.abs(F.xxhash64("node", "key"))
    own = lambda c: (spread % F.col(c)).cast("int")
    every = lambda c, f: F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    left, right = every("nr", lambda j: place(0, own("nl"), j)), every("nl", lambda i: place(1, i, own("nr")))
    at = F.explode(F.when(F.col("comp") != F.col("main"), F.concat(left, right)).otherwise(right)).alias("at")
    rows = m.select("key", "band", "node", "comp", "main", "n", "sig", "bands", at).select("*", "at.*").drop("at")
    # Dealt anew: by key alone, as the join leaves them, all blocks of a full bucket would be one task's.
    rows = rows.repartition("key", "i", "j")
    wanted = materialise(rows.groupBy("key", "i", "j").applyInArrow(_wanted(threshold_pct, miss), rows.schema), "wanted")
    nodes = wanted.select(F.col("node").alias("_id")).distinct()
    sets = map_text(docs.join(sized(nodes, "nodes"), "_id", "left_semi"), emit, "s array<bigint>", ["_id"]).withColumnRenamed("_id", "node")
    found = wanted.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_block(threshold_pct, miss), "a long, b long").distinct()
    more = materialise(found, "more")
    discard(members, wanted)
    return more


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = 75, miss: float = 1e-6
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per input row.

    component_id is the smallest doc_id reachable over links of a Jaccard
    similarity of ``threshold_pct`` percent or more.  Null and empty texts, and
    texts of white space, have no shingles and are components of their own.
    Rows that repeat a doc_id count as one document with the links of each row.
    A row without doc_id gets a null component and is kept.  Further columns are
    ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = id_and_text(docs, id_col, text_col)
    sk = materialise(map_text(docs, sketch, "n int, set_key binary, sig binary, bands array<bigint>", ["_id"]), "sketch")
    usable = sk.where("_id is not null and set_key is not null")
    reps = usable.groupBy("set_key").agg(F.min(F.struct("_id", "n", "sig", "bands")).alias("x"))
    reps = materialise(reps.select("set_key", F.col("x._id").alias("node"), "x.n", "x.sig", "x.bands"), "reps")

    bucket = reps.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = bucket.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    # Written first: a join of two scans can be split at a full bucket, one on an aggregate can't.
    member = materialise(bucket.join(materialise(hubs, "hubs"), "key").where("node <> hub"), "member")
    star = member.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    link = materialise(_links(star, reps, docs, threshold_pct, miss), "link")
    comp = materialise(components(link.select(F.col("a").alias("u"), F.col("b").alias("v"))), "comp")

    # Second pass: buckets whose members are in several components; the hub has met all.
    placed = member.join(comp, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    mixed = materialise(mixed.select("key"), "mixed")
    more = _block_links(placed.join(mixed, "key", "left_semi"), reps, docs, threshold_pct, miss)
    if not more.isEmpty():
        comp = materialise(components(link.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "comp")
    discard(member)

    where = reps.select("set_key", "node").join(comp, "node", "left")
    where = where.select("set_key", F.coalesce("component", "node").alias("component"))
    out = sk.select("_id", "n", "set_key").join(where, "set_key", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows without a
    doc_id stay."""
    (drop,) = fresh(docs, "drop")
    dropped = decided.where("not kept").select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(sized(dropped, "dropped"), F.col(id_col) == F.col(drop), "left_anti")
