"""Cheapest routes of at most three conversions, as joins and ranking windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import ENGINE_NAMES, ENGINES, KNOB_ORDER, edges_df


def usable(spark: SparkSession, engines: Iterable[str] = ENGINES, excluding: Iterable[str] = ()) -> DataFrame:
    """Edges whose engine is built in or present and whose key isn't excluded."""
    e = edges_df(spark)
    present = spark.createDataFrame([("",), *((x,) for x in engines)], "engine string")
    out = spark.createDataFrame([(x,) for x in excluding], "key string")
    return e.join(F.broadcast(present), "engine", "left_semi").join(F.broadcast(out), "key", "left_anti")


def routes(spark: SparkSession, engines: Iterable[str] = ENGINES, excluding: Iterable[str] = ()) -> DataFrame:
    """(src, dst, cost, hops, keys, engines, knobs, variant, lossy, multi): the
    cheapest route of every reachable pair; ties go to fewer hops, then to the
    smaller list of keys.

    A terminal edge ends a route and an initial one begins it; a route of several
    edges has no self edge and doesn't come back to its source, so a self target is
    reached by a direct self edge only.  The relation is bounded by the static edge
    table, which every join broadcasts."""
    return _cheapest_routes(usable(spark, engines, excluding), [])


def routes_without(spark: SparkSession, edges: Iterable[str], engines: Iterable[str] = ENGINES) -> DataFrame:
    """routes() once for each of ``edges``, which is left out, in one plan; that edge
    is the column ``without``.  Bounded by the square of the static edge table."""
    out = F.broadcast(spark.createDataFrame([(x,) for x in edges], "without string"))
    return _cheapest_routes(usable(spark, engines).join(out, F.col("key") != F.col("without")), ["without"])


def _cheapest_routes(e: DataFrame, by: list[str]) -> DataFrame:
    """The routes over the edges ``e``, apart for each value of ``by``."""
    step = F.struct("key", "engine", "knobs", "variant", "lossy", "multi")
    one = e.select(*by, "src", "dst", F.col("weight").alias("cost"), F.array(step).alias("path"), "terminal")
    inner = e.where("src <> dst and not initial")
    further = F.broadcast(inner.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("src").alias("at"), F.col("dst").alias("to"), "weight", step.alias("step"), F.col("terminal").alias("ends")))

    def longer(paths: DataFrame) -> DataFrame:
        follows = F.col("dst") == F.col("at")
        for c in by:
            follows &= F.col(c) == F.col(f"_{c}")
        j = paths.where("not terminal and src <> dst").join(further, follows).where("to <> src")
        return j.select(*by, "src", F.col("to").alias("dst"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("step")).alias("path"), F.col("ends").alias("terminal"))

    def cheapest(paths: DataFrame, *more: str) -> DataFrame:
        keys = F.transform("path", lambda s: s["key"])
        w = W.partitionBy(*by, "src", "dst", *more).orderBy("cost", F.size("path"), keys)
        return paths.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    # A cheaper path to the same place with the same right to go on is never worse.
    first = cheapest(one, "terminal")
    second = cheapest(longer(first), "terminal")
    best = cheapest(first.unionByName(second).unionByName(longer(second)))
    field = lambda name: F.transform("path", lambda s: s[name])
    return best.select(
        *by,
        "src",
        "dst",
        "cost",
        F.size("path").alias("hops"),
        field("key").alias("keys"),
        F.array_distinct(F.filter(field("engine"), lambda x: x != "")).alias("engines"),
        F.array_intersect(F.array(*map(F.lit, KNOB_ORDER)), F.flatten(field("knobs"))).alias("knobs"),
        F.coalesce(F.get(F.filter(field("variant"), lambda x: x != ""), 0), F.lit("")).alias("variant"),
        F.exists("path", lambda s: s["lossy"]).alias("lossy"),
        F.exists("path", lambda s: s["multi"]).alias("multi"),
    )


def targets(sources: DataFrame, routes: DataFrame) -> DataFrame:
    """Targets that every distinct format in ``sources`` (src) reaches."""
    wanted = sources.select("src").distinct()
    n = wanted.agg(F.count("*").alias("n"))
    reached = routes.join(F.broadcast(wanted), "src", "left_semi").groupBy("dst").agg(F.count("*").alias("m"))
    return reached.join(F.broadcast(n), F.col("m") == F.col("n")).select("dst")


def blocked_targets(sources: DataFrame, have: DataFrame, every: DataFrame) -> DataFrame:
    """(dst, needed): targets that only further engines would open, and which.
    have: routes with the engines present; every: routes with all engines."""
    locked = targets(sources, every).join(targets(sources, have), "dst", "left_anti")
    wanted = sources.select("src").distinct()
    need = every.join(F.broadcast(wanted), "src", "left_semi").join(locked, "dst")
    known = have.join(F.broadcast(wanted), "src", "left_semi").select("src", "dst", F.lit(True).alias("open"))
    need = need.join(known, ["src", "dst"], "left").where("open is null").select("dst", F.explode("engines").alias("engine"))
    return need.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("needed"))


def route_words(routes: DataFrame) -> DataFrame:
    """Adds ``line``: each edge of the route with the name of who does it."""
    names = F.create_map(*[F.lit(x) for k, v in ENGINE_NAMES.items() for x in (k, v)])
    by = lambda k: F.substring_index(k, "@", -1)
    to = lambda k: F.substring_index(F.substring_index(k, "@", 1), ">", -1)
    step = lambda k: F.concat(to(k), F.lit(" ("), F.coalesce(F.try_element_at(names, by(k)), F.lit("built in")), F.lit(")"))
    return routes.withColumn("line", F.array_join(F.concat(F.array("src"), F.transform("keys", step)), " → "))


def matrix(spark: SparkSession) -> DataFrame:
    """(src, dst, engine, weight): the cheapest direct edge of a pair, packing
    left out; ties go to the engine that sorts first, built in before all."""
    e = edges_df(spark).where("not pack")
    best = e.groupBy("src", "dst").agg(F.min(F.struct("weight", "engine")).alias("b"))
    return best.select("src", "dst", F.col("b.engine").alias("engine"), F.col("b.weight").alias("weight"))
