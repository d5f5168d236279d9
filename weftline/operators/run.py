"""A whole job on files as rows: detect, plan, check the knobs, convert, name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.convert import convert, route_path
from weftline.operators.jobs import output_name, plan_files
from weftline.plans.catalog import formats
from weftline.plans.planner import routes

Routes = tuple[DataFrame, DataFrame]


def planned_routes(spark: SparkSession, target: str) -> Routes:
    """The routes to one target, by built-in steps and by all engines, planned once:
    a row a format, held by the driver."""
    held = []
    for r in (routes(spark, ()), routes(spark)):
        r = r.where(F.col("dst") == target)
        held.append(spark.createDataFrame(r.collect(), r.schema))
    return held[0], held[1]


def run_files(files: DataFrame, target: str, content: str = "content", name: str = "name", knobs: str | None = None, size: str | None = None, plan: Routes | None = None) -> DataFrame:
    """The files' own columns but ``content``, with output, result, error_code and
    detail, a row a file, by built-in steps.

    A file without a usable plan, or whose knobs (a map<string,string> column) aren't
    allowed on its route, keeps its row with the code and the name that its output would have, and never reaches a parser.
    No step shuffles: the plan is a broadcast of a row a format."""
    own, full = plan or planned_routes(files.sparkSession, target)
    planned = plan_files(files, own, full, target, name, size, knobs)
    ext = next((f.ext[0] for f in formats() if f.id == target), target)
    pdfa = F.coalesce(F.col(knobs)["pdfa"] == "true", F.lit(False)) if knobs else None
    kept = [F.col(f"`{c}`") for c in files.columns if c != content]
    route = F.when(F.col("error_code").isNull(), route_path(F.col("keys")))
    staged = planned.select(*kept, F.col(f"`{content}`"), F.col("error_code").alias("_planned"), F.col("missing").alias("_missing"), output_name("stem", "format", F.lit(target), F.lit(ext), pdfa).alias("output"), route.alias("_route"))
    # What has no route is passed over before its bytes go to Python.
    staged = staged.withColumn(content, F.when(F.col("_planned").isNull(), F.col(f"`{content}`")))
    made = convert(staged, content, "_route", knobs, name)
    code = F.coalesce("_planned", "error_code")
    return made.select(*kept, "output", "result", code.alias("error_code"), F.coalesce("_missing", "detail").alias("detail"))
