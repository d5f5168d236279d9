"""Format detection by file name, as broadcast joins to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.catalog import formats_df


def detect(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds format (null if unknown) and stem.

    The folder goes at the last slash of either kind.  Compound extensions such as
    tar.gz come first and need something before them; else the part after the last
    dot counts, which may be neither first nor last in the name."""
    ext = formats_df(files.sparkSession).select(F.col("id").alias("format"), F.explode("ext").alias("_ext"))
    compound = F.broadcast(ext.where("_ext like '%.%'").select(F.col("format").alias("_double"), F.col("_ext").alias("_two")))
    simple = F.broadcast(ext.where("_ext not like '%.%'").select(F.col("format").alias("_single"), F.col("_ext").alias("_one")))
    base = F.regexp_replace(F.col(name), r"(?s)\A.*[/\\]", "")
    low = F.lower("_base")
    f = files.withColumn("_base", base)
    f = f.withColumn("_last2", F.regexp_extract(low, r"(?s)\A.+\.([^.]+\.[^.]+)\z", 1)).withColumn("_last1", F.regexp_extract(low, r"(?s)\A.+\.([^.]+)\z", 1))
    j = f.join(compound, F.col("_last2") == F.col("_two"), "left").join(simple, F.col("_last1") == F.col("_one"), "left")
    cut = F.when(F.col("_double").isNotNull(), F.length("_last2") + 1).when(F.col("_last1") != "", F.length("_last1") + 1).otherwise(0)
    return j.select(
        *files.columns, F.coalesce("_double", "_single").alias("format"), F.left("_base", F.length("_base") - cut).alias("stem")
    )
