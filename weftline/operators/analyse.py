"""What a selection of files can become: the decision behind a chooser."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.detect import detect
from weftline.operators.jobs import merge_targets
from weftline.plans.catalog import ENGINES
from weftline.plans.planner import routes


def analyse(files: DataFrame, selection: str, name: str = "name", engines: Iterable[str] = ENGINES) -> DataFrame:
    """(selection, target, state, needed): every target of each selection as

    * open: all its formats reach it with the engines present;
    * blocked: only further engines, listed in ``needed``, would open it;
    * merge: the whole selection can become one such file.

    Unknown formats are left out.  A selection is first reduced to its distinct
    formats, so the joins see at most a catalogue's rows for each selection."""
    spark = files.sparkSession
    own, full = routes(spark, engines), routes(spark)
    known = detect(files, name).where("format is not null").select(selection, F.col("format").alias("src")).distinct()
    sizes = known.groupBy(selection).agg(F.count("*").alias("n"))

    def reached(r: DataFrame) -> DataFrame:
        j = known.join(F.broadcast(r.select("src", "dst", "engines")), "src").groupBy(selection, "dst").agg(F.count("*").alias("m"), F.flatten(F.collect_list("engines")).alias("e"))
        return j.join(sizes, selection).where("m = n").select(selection, "dst", "e")

    have = reached(own).select(selection, "dst", F.lit("open").alias("state"))
    present = F.array(*map(F.lit, engines)).cast("array<string>")
    need = F.array_join(F.array_sort(F.array_distinct(F.array_except("e", present))), ",")
    locked = reached(full).join(have.select(selection, "dst"), [selection, "dst"], "left_anti")
    merged = merge_targets(known.withColumn("format", F.col("src")), selection, "format")
    return (
        have.select(selection, F.col("dst").alias("target"), "state", F.lit("").alias("needed"))
        .unionByName(locked.select(selection, F.col("dst").alias("target"), F.lit("blocked").alias("state"), need.alias("needed")))
        .unionByName(merged.select(selection, "target", F.lit("merge").alias("state"), F.lit("").alias("needed")))
    )
