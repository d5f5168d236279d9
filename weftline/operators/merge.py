"""Many files to one: pictures to the pages of a PDF, any files to an archive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.codecs import archives, pdf
from weftline.operators.convert import READ_PICTURE
from weftline.operators.detect import detect
from weftline.operators.jobs import MAX_ENTRIES, MAX_UNPACKED, merge_targets
from weftline.plans.catalog import GROUPS, formats


def merge(files: DataFrame, selection: str, target: str, name: str = "name", content: str = "content", order: str = "name", limit: int = MAX_UNPACKED) -> DataFrame:
    """(selection, output, n, result, error_code, detail), one row per selection,
    named after its first file; any file's failure fails the whole selection.

    Sizes are summed first, and selections beyond ``limit`` bytes or MAX_ENTRIES
    files are errors without being gathered, so a group is never more than that.
    Moving pictures need an engine and are reported so."""
    f = detect(files, name).withColumn("__size", F.coalesce(F.octet_length(content).cast("long"), F.lit(0)))
    first = F.min_by("stem", order)
    sums = f.groupBy(selection).agg(F.count("*").alias("n"), F.sum("__size").alias("__total"), first.alias("__stem"))
    can = merge_targets(f, selection, "format").where(F.col("target") == target).select(selection, F.lit(True).alias("__can"))
    plan = sums.join(can, selection, "left")
    code = (
        F.when(F.col("__can").isNull(), "no_route")
        .when(F.lit(target in ("mp4", "webm", "mkv", "gif")), "engine_missing")
        .when((F.col("__total") > limit) | (F.col("n") > MAX_ENTRIES), "too_large")
    )
    ext = next((x.ext[0] for x in formats() if x.id == target), target)
    plan = plan.select(selection, "n", F.concat("__stem", F.lit(f".{ext}")).alias("output"), code.alias("error_code"))
    ready = f.join(plan.where("error_code is null").select(selection), selection, "left_semi")
    kind = files.select(selection).schema[0].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("__order", "__name", "__format", "__data")), strict=True), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
        result, code, detail = None, None, None
        try:
            if any(r[3] is None for r in rows):
                code, detail = "read_failed", next(r[1] for r in rows if r[3] is None)
            elif target in GROUPS["packable"].split():
                names = archives.unique_names([r[1] or "" for r in rows])
                result = archives.write([archives.Entry(n, r[3]) for n, r in zip(names, rows, strict=True)], target)
            else:
                result = pdf.write_pictures([r[3] if r[2] == "jpg" else READ_PICTURE[r[2]](r[3]) for r in rows])
        except Exception as e:  # any fault of one file's parser fails its selection only
            code, detail = "convert_failed", f"{type(e).__name__}: {e}"[:200]
        return pa.table({selection: t.column(selection)[:1], "result": pa.array([result], pa.binary()), "__code": pa.array([code], pa.string()), "detail": pa.array([detail], pa.string())})

    few = ready.select(selection, F.col(order).alias("__order"), F.col(name).alias("__name"), F.col("format").alias("__format"), F.col(content).cast("binary").alias("__data"))
    made = few.groupBy(selection).applyInArrow(run, f"{selection} {kind}, result binary, __code string, detail string")
    out = plan.join(made, selection, "left")
    return out.select(selection, "output", "n", "result", F.coalesce("error_code", "__code").alias("error_code"), "detail")
