"""Running planned files through steps, with one planned retry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.jobs import plan_files
from weftline.plans.catalog import ENGINES
from weftline.plans.planner import routes, routes_without
from weftline.work import materialise

#: Runs routes: takes (..., keys) rows and adds result, error_code and failed_key.
Run = Callable[[DataFrame], DataFrame]


def run_with_retry(files: DataFrame, target: str, run: Run, engines: Iterable[str] = ENGINES, name: str = "name") -> DataFrame:
    """The files' results; those whose engine failed are planned once more without
    the edge that failed.  If that fails too, the first error stays.

    The first pass is written before it is split, so no engine runs twice for one
    file.  All retries are one plan: routes without the failed edge, keyed by that
    edge, of which there are at most as many as the catalogue has."""
    spark = files.sparkSession
    own, full = routes(spark, engines), routes(spark)
    planned = plan_files(files, own, full, target, name)
    ready = planned.where("error_code is null").drop("error_code", "missing")
    first = materialise(run(ready), "first")
    columns = [*files.columns, "format", "stem", "result", "error_code"]
    done = first.where("error_code is null or error_code <> 'engine_failed'").select(*columns)
    nothing = F.lit(None).cast("binary")
    unplanned = planned.where("error_code is not null").withColumn("result", nothing).select(*columns)
    # The distinct failed edges are bounded by the static edge table.
    failed = [r[0] for r in first.where("error_code = 'engine_failed' and failed_key is not null").select("failed_key").distinct().collect()]
    other = routes_without(spark, failed, engines).where(F.col("dst") == target).select(F.col("without").alias("_key"), F.col("src").alias("_src"), F.col("keys").alias("_keys"), F.col("engines").alias("_engines"))
    again = first.where("error_code = 'engine_failed'").select(*files.columns, "format", "stem", F.col("error_code").alias("first_code"), "failed_key")
    again = again.join(F.broadcast(other), (F.col("failed_key") == F.col("_key")) & (F.col("format") == F.col("_src")), "left")
    possible = again.where("_keys is not null").withColumnsRenamed({"_keys": "keys", "_engines": "engines"}).drop("_key", "_src", "failed_key")
    tried = run(possible).withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.col("first_code")))
    none = again.where("_keys is null").select(*files.columns, "format", "stem", nothing.alias("result"), F.col("first_code").alias("error_code"))
    return done.unionByName(unplanned).unionByName(tried.select(*columns)).unionByName(none)
