"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks of B.  With weight w, the source's block k is
released at slot floor(k / w) and due by slot ceil((k + 1) / w); of the released
blocks the one due first takes the slot.  So at any slot a source has had its
share but for less than one block.  Weights are exact fractions a_i / Q, never
rounded, and the schedule repeats every Q slots: one period is simulated, and block
k of source i has the slot (k // a_i) * Q + first[i][k mod a_i], a lookup, whatever
the number of blocks.  Where the sources' blocks end before the period does, the
simulation ends with them: it never has more slots than there are blocks.

No document is dropped: when a source has no block for a slot due to it, a new
phase begins with the weights of those that have blocks left.  There are at most
as many phases as sources, and the deviation of each phase starts anew: over p phases
a source is within p blocks of the sum of its shares of them.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, fresh, materialise

#: The sources that the driver can take.
MOST_SOURCES = 1000
#: Slots in the phases' rows that are broadcast at most, three numbers each.
FEW_SLOTS = 1 << 20
#: Documents of one (source, cell) on average.
CELL = 1000
#: The columns that mixing adds.
PLACES = ("__phase", "__block", "__release", "__due", "__slot", "__position")


def shares(weights: Mapping[str, float | Fraction], period: int | None = None) -> dict[str, int]:
    """Blocks of each source in a period, in exactly the weights' proportion (a
    float is the decimal that it prints as); or, only where a period is asked for,
    whole slots of it: largest remainders, 1 at least."""
    given = {s: Fraction(str(w)) for s, w in weights.items()}
    if period is None:
        size = math.lcm(*(w.denominator for w in given.values()))
        whole = {s: int(w * size) for s, w in given.items()}
        part = math.gcd(*whole.values())
        return {s: a // part for s, a in whole.items()}
    total = sum(given.values())
    exact = {s: w / total * period for s, w in given.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    k = 0
    while (rest := period - sum(out.values())) > 0:
        out[by_rest[k % len(by_rest)]] += 1
        k += 1
    while rest < 0:
        s = max((x for x in out if out[x] > 1), key=lambda x: (out[x] - exact[x], x))
        out[s] -= 1
        rest += 1
    return out


def one_period(share: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source in one period: earliest deadline first among
    released blocks; equal deadlines go to the heavier source, then by name.  With
    ``blocks`` it ends before a slot whose source has no block left for it."""
    period = sum(share.values())
    slots: dict[str, list[int]] = {s: [] for s in share}
    later: list[tuple[int, int, int, str]] = []
    ready = [(-(-period // a), -a, s) for s, a in share.items()]
    heapq.heapify(ready)
    t = 0
    while t < period:
        while later and later[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        if not ready:
            raise AssertionError("a slot without a released block")
        due, _, s = heapq.heappop(ready)
        if t >= due:
            raise AssertionError(f"{s}'s block is late")
        if blocks and len(slots[s]) >= blocks[s]:
            break
        slots[s].append(t)
        k, a = len(slots[s]), share[s]
        if k < a:
            heapq.heappush(later, (max(k * period // a, t + 1), -(-(k + 1) * period // a), -a, s))
        t += 1
    return slots


def plan(blocks: Mapping[str, int], weights: Mapping[str, float | Fraction], period: int | None = None) -> list[tuple]:
    """Rows (phase, source, first_block, last_block, period, slots, releases, dues,
    start): blocks first_block..last_block - 1 of the source are scheduled in the
    phase, whose first slot is ``start`` of the whole mix.  The lists are of the
    source's blocks in one period, or as far as the phase goes."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, phase, out = 0, 0, []
    while left:
        share = shares({s: weights[s] for s in left}, period and max(period, len(left)))
        own, size = one_period(share, left), sum(share.values())
        length = sum(map(len, own.values()))
        if length == size:  # the whole period: it repeats until a source ends
            slot = lambda s, k: k // share[s] * size + own[s][k % share[s]]  # noqa: E731, B023
            length = min(slot(s, n) for s, n in left.items())
            if len(left) == 1:
                length = next(iter(left.values()))
        every = min(size, length)
        for s in list(left):
            full, rest = divmod(length, size)
            n = min(left[s], full * share[s] + sum(x < rest for x in own[s]))
            if not n:
                continue
            a, k = share[s], range(len(own[s]))
            out.append((phase, s, done[s], done[s] + n, every, own[s], [x * size // a for x in k], [-(-(x + 1) * size // a) for x in k], start))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start, phase = start + length, phase + 1
    return out


def _key(source: Column) -> Column:
    """A source's name, with a null one apart from all others."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float | Fraction] | None = None,
    block: int = 8,
    id_col: str = "doc_id",
    source_col: str = "source",
    period: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with __phase, __block, __release, __due,
    __slot and __position, the row's place in the mix (0, 1, 2, ...).

    weights: target weight per source, positive; without them all sources weigh
    the same.  Sources without a weight get the smallest one given.  Within a
    source the order is that of a hash of doc_id, then doc_id.  Null sources are a
    source of their own; null doc_ids and repeated rows are scheduled like others;
    an empty table gives an empty result; columns of the result's own names are
    replaced.  More than MOST_SOURCES distinct sources
    are a ValueError, as the driver plans for each.  ``period`` rounds the weights to whole
    slots of a period; without it they hold exactly.  What the driver simulates and
    broadcasts, three numbers a slot, is the exact period or, where that is longer
    than a phase (weights of many digits), the phase: at most one entry a block.

    A row's rank in its source comes from cells: the source's rows are dealt by
    hash into cells of about CELL rows, whose counts are summed up in order, so a
    source with a third of all rows is ranked by as many tasks as its size asks."""
    if any(not w > 0 for w in (weights or {}).values()):
        raise ValueError("weights must be positive")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in PLACES])
    source, h, cell, own, rank, blk = fresh(docs, "source", "hash", "cell", "own", "rank", "blk")
    id_, key_ = F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string")
    n_cells = max(1, -(-docs.select(id_).count() // CELL))
    keyed = docs.withColumns({source: _key(key_), h: F.xxhash64(id_)})
    keyed = keyed.withColumn(cell, F.floor((F.col(h) / 2.0**64 + 0.5) * n_cells).cast("int"))

    cells = materialise(keyed.select(F.col(source).alias("s"), F.col(cell).alias("c")).groupBy("s", "c").agg(F.count("*").alias("n")), "cells")
    before = F.sum("n").over(W.partitionBy("s").orderBy("c").rowsBetween(W.unboundedPreceding, -1))
    cells_before = cells.select("s", "c", F.coalesce(before, F.lit(0)).alias("before")).alias("y")
    totals = {r[0]: r[1] for r in cells.groupBy("s").agg(F.sum("n")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    given = {"null" if s is None else f"={s}": w for s, w in (weights or {}).items()}
    least = min(given.values(), default=1.0)
    rows = plan({s: -(-n // block) for s, n in totals.items()}, {s: given.get(s, least) for s in totals}, period)
    schema = "phase int, s string, first long, last long, period long, slots array<long>, releases array<long>, dues array<long>, start long"
    phases = spark.createDataFrame(rows, schema)
    # The last block of a source may be short: what the blocks before a slot lack of B rows each.
    short = sorted((_slot_of(r, r[3] - 1), block - n) for s, t in totals.items() if (n := (t - 1) % block + 1) < block for r in [next(x for x in reversed(rows) if x[1] == s)])
    lacking = F.from_json(F.lit("[" + ",".join(f'{{"s":{a},"d":{b}}}' for a, b in short) + "]"), "array<struct<s:bigint,d:bigint>>")

    order = F.row_number().over(W.partitionBy(source, cell).orderBy(h, id_)) - 1
    r, y = keyed.withColumn(own, order).alias("r"), cells_before
    ranked = r.join(y, (F.col(f"r.{source}") == F.col("y.s")) & (F.col(f"r.{cell}") == F.col("y.c")))
    ranked = ranked.select("r.*", (F.col("y.before") + F.col(f"r.{own}")).alias(rank)).withColumn(blk, F.floor(F.col(rank) / block))
    few = sum(len(x[5]) for x in rows) <= FEW_SLOTS
    b, x = ranked.alias("b"), (F.broadcast(phases) if few else phases).alias("x")
    placed = b.join(x, (F.col(f"b.{source}") == F.col("x.s")) & (F.col(f"b.{blk}") >= F.col("x.first")) & (F.col(f"b.{blk}") < F.col("x.last")))
    k, a = F.col(f"b.{blk}") - F.col("x.first"), F.size("x.slots")
    at = lambda c: F.floor(k / a) * F.col("x.period") + F.get(F.col(f"x.{c}"), (k % a).cast("int")) + F.col("x.start")
    inside, slot = F.col(f"b.{rank}") % block, at("slots")
    lost = F.aggregate(F.filter(lacking, lambda g: g["s"] < slot), F.lit(0).cast("long"), lambda acc, g: acc + g["d"])
    return placed.select(
        *[F.col(f"b.`{c}`") for c in docs.columns],
        F.col("x.phase").alias("__phase"),
        F.col(f"b.{blk}").alias("__block"),
        at("releases").alias("__release"),
        at("dues").alias("__due"),
        slot.alias("__slot"),
        (slot * block + inside - lost).alias("__position"),
    )


def _slot_of(row: tuple, block: int) -> int:
    _, _, first, _, period, slots, _, _, start = row
    k = block - first
    return k // len(slots) * period + slots[k % len(slots)] + start


def in_order(mixed: DataFrame, total: int, parts: int | None = None) -> DataFrame:
    """The ``total`` mixed rows in their order.  Positions have no gaps, so equal
    runs of them are the partitions, without sampling; files read one after
    another follow the schedule."""
    parts = parts or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, -(-total // parts))
    dealt = mixed.repartitionById(parts, F.floor(F.col("__position") / run).cast("int"))
    return dealt.sortWithinPartitions("__position")


def placed(written: DataFrame) -> DataFrame:
    """Rows of ``in_order``, written and read back, with __position: the rows of the
    files before, which Spark numbers by partition, and the row's number in its own.
    However the files are split or in what order they are read, the place stays."""
    spark = written.sparkSession
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    counts = written.select(file.alias("__file")).groupBy("__file").count().collect()
    number = lambda f: [int(x) for x in re.fullmatch(r"part-(\d+)-.*?(?:-c(\d+))?\..*", f).groups("0")]
    rows, before = [], 0
    for f, n in sorted(counts, key=lambda r: number(r[0])):
        rows.append((f, before))
        before += n
    starts = spark.createDataFrame(rows, "__file string, __before long")  # a row a file
    numbered = written.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    joined = numbered.join(F.broadcast(starts), "__file")
    return joined.select(*written.columns, (F.col("__before") + F.col("__row")).alias("__position"))
