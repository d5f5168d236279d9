"""The job around conversions: knobs, routing of files, limits, names, merging, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.detect import detect
from weftline.plans.catalog import GROUPS, KNOB_CHOICES, KNOB_RANGES, formats
from weftline.work import numbered

# Limits of built-in steps, and the failure codes.
MAX_INPUT, MAX_UNPACKED, MAX_ENTRIES, MAX_OUTPUTS = 64 << 20, 128 << 20, 100_000, 64
CODES = (
    "unknown_format", "no_target", "no_route", "engine_missing", "engine_failed", "too_large",
    "read_failed", "write_failed", "convert_failed", "bad_options", "cancelled",
)
MERGE_PICTURES = ("pdf", "mp4", "webm", "mkv", "gif")


def size_code(size: Column, limit: int = MAX_INPUT) -> Column:
    """too_large for contents beyond the limit of built-in steps, else null."""
    return F.when(size > limit, "too_large")


def page_range(text: Column) -> Column:
    """struct<first, last> of "", "3", "2-5" or "2-": 0 is open; null if malformed."""
    t = F.trim(F.coalesce(text, F.lit("")))
    first = F.regexp_extract(t, r"\A([0-9]{1,9})\s*(?:-\s*([0-9]{0,9}))?\z", 1).try_cast("int")
    last = F.regexp_extract(t, r"\A([0-9]{1,9})\s*(?:-\s*([0-9]{0,9}))?\z", 2)
    end = F.when(~t.contains("-"), first).when(last == "", 0).otherwise(last.try_cast("int"))
    ok = (first >= 1) & ((end == 0) | (end >= first))
    pair = F.struct(first.alias("first"), end.alias("last"))
    return F.when(t == "", F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))).when(ok, pair)


def knob_fails(knob: Column, value: Column, variant: Column) -> Column:
    """Whether a knob's value isn't allowed; an absent value and an unknown knob are."""
    number = F.trim(value).try_cast("int")
    bad = F.when(F.coalesce(value, F.lit("")) == "", False).when(knob == "pages", page_range(value).isNull())
    for k, (least, most, _) in KNOB_RANGES.items():
        bad = bad.when(knob == k, number.isNull() | (number < least) | (number > most))
    for (k, of), words in KNOB_CHOICES.items():
        if k not in ("pdfa", "merge"):  # any text is a truth value
            here = variant.isin(of, "") if (k, of) == ("preset", "video") else (F.lit(of == "") | (variant == of))
            bad = bad.when((knob == k) & here, ~value.isin(*words.split()))
    return bad.otherwise(False)


def invalid_knobs(answers: DataFrame) -> DataFrame:
    """Of (knob, value, variant), those whose value isn't allowed."""
    return answers.where(knob_fails(F.col("knob"), F.col("value"), F.coalesce("variant", F.lit(""))))


def int_knob(value: Column, knob: str) -> Column:
    """A number within the knob's range, its default where there is none."""
    lo, hi, default = KNOB_RANGES[knob]
    return F.least(F.greatest(F.coalesce(F.trim(value).try_cast("int"), F.lit(default)), F.lit(lo)), F.lit(hi))


def plan_files(files: DataFrame, routes: DataFrame, every: DataFrame, target: str, name: str = "name", size: str | None = None, knobs: str | None = None) -> DataFrame:
    """Adds format, stem, the route's keys and engines, and error_code; missing names
    the engines that lack or the knobs (of a map column) that the route has and whose
    values aren't allowed.  Errors are rows, never exceptions.

    Routes of a static catalogue are a broadcast table; a pair is planned once,
    however many files have it."""
    d = detect(files, name)
    to = [F.broadcast(r.where(F.col("dst") == target).select(F.col("src").alias(f"_{p}"), F.col("keys").alias(f"{p}_keys"), F.col("engines").alias(f"{p}_engines"), F.col("knobs").alias(f"{p}_knobs"), F.col("variant").alias(f"{p}_variant"))) for r, p in ((routes, "own"), (every, "all"))]
    j = d.join(to[0], F.col("format") == F.col("_own"), "left").join(to[1], F.col("format") == F.col("_all"), "left")
    local = F.size("own_engines") == 0
    large = (F.col(size) > MAX_INPUT) & local if size else F.lit(False)
    bad = F.array().cast("array<string>")
    if knobs:
        bad = F.array_sort(F.filter("own_knobs", lambda k: knob_fails(k, F.col(knobs)[k], F.col("own_variant"))))
    code = (
        F.when(F.lit(target not in {f.id for f in formats()}), "no_target")
        .when(F.col("format").isNull(), "unknown_format")
        .when(F.col("own_keys").isNull() & F.col("all_keys").isNotNull(), "engine_missing")
        .when(F.col("own_keys").isNull(), "no_route")
        .when(F.size(bad) > 0, "bad_options")
        .when(large, "too_large")
    )
    missing = F.when(code == "engine_missing", F.array_join("all_engines", ",")).when(code == "bad_options", F.array_join(bad, ", "))
    return j.select(*files.columns, "format", "stem", F.col("own_keys").alias("keys"), F.col("own_engines").alias("engines"), code.alias("error_code"), missing.alias("missing"))


def page_number(name: Column) -> Column:
    """The number in a produced name such as out-03.png, else 0."""
    return F.coalesce(F.regexp_extract(name, r"-([0-9]{1,9})\.[A-Za-z0-9]+\z", 1).try_cast("int"), F.lit(0))


def _base(stem: str, src: str, dst: Column | str, pdfa: Column | None) -> Column:
    mark = F.when(pdfa if pdfa is not None else F.lit(False), ".pdfa").otherwise(".compressed")
    return F.concat(F.col(stem), F.when(F.col(src) == dst, mark).otherwise(""))


def output_name(stem: str, src: str, dst: Column, ext: Column, pdfa: Column | None = None) -> Column:
    """The name of a file's only output: stem.ext, marked where the format stays."""
    return F.concat(_base(stem, src, dst, pdfa), F.lit("."), ext)


def output_names(items: DataFrame, file: str, stem: str, src: str, dst: str, ext: str, page: str, pdfa: Column | None = None) -> DataFrame:
    """Adds output: stem.ext; stem-page.ext for sets of pages; a mark before the
    extension where the format stays."""
    base = _base(stem, src, F.col(dst), pdfa)
    w = W.partitionBy(file)
    several = (F.count("*").over(w) > 1) | (F.col(page) > 0)
    place = F.row_number().over(w.orderBy(page))
    number = F.when(F.col(page) > 0, F.col(page)).otherwise(place)
    return items.withColumn("output", F.concat(base, F.when(several, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), F.lit("."), F.col(ext)))


def clean_entry_name(name: Column, is_dir: Column) -> Column:
    """An archive member's name made relative, with / between folders; null where
    it would leave the folder."""
    n = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"\A/+", "")
    parts = F.filter(F.split(n, "/", -1), lambda p: (p != "") & (p != "."))
    bad = F.exists(F.split(n, "/", -1), lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.concat(F.array_join(parts, "/"), F.when(is_dir, "/").otherwise("")))


def pack_names(files: DataFrame, archive: str, name: str, order: str) -> DataFrame:
    """Adds entry: the file's own name, with -2, -3, ... before the extension where
    an earlier file of the archive has it.

    Names are numbered within (archive, name) by ranges, so neither an archive nor a
    name of any size is one task's rows."""
    base = F.regexp_replace(F.replace(F.coalesce(F.col(name), F.lit("")), F.lit("\\"), F.lit("/")), r"(?s)\A.*/", "")
    f = numbered(files.withColumn("_n", F.when(base.isin("", "."), "file").otherwise(base)), [archive, "_n"], [order], "_k")
    ext = F.regexp_extract("_n", r"(\.[^.]*)\z", 1)
    again = F.concat(F.left("_n", F.length("_n") - F.length(ext)), F.lit("-"), F.col("_k").cast("string"), ext)
    return f.withColumn("entry", F.when(F.col("_k") == 1, F.col("_n")).otherwise(again)).drop("_n", "_k")


def merge_targets(selections: DataFrame, selection: str, fmt: str) -> DataFrame:
    """(selection, target): what a whole selection can become as one file."""
    coded = GROUPS["coded"].split()
    s = selections.groupBy(selection).agg(F.bool_and(F.coalesce(F.col(fmt).isin(*coded), F.lit(False))).alias("all_pictures"))
    packs = F.array(*map(F.lit, GROUPS["packable"].split()))
    every = F.when(F.col("all_pictures"), F.concat(F.array(*map(F.lit, MERGE_PICTURES)), packs)).otherwise(packs)
    return s.select(selection, F.explode(every).alias("target"))


def summary(results: DataFrame, job: str, file: str, code: str) -> DataFrame:
    """(job, total, done, failed, message): counts and the first three errors by
    file name.  The three are kept by a ranking within (job, failed rows)."""
    bad = results.where(F.col(code).isNotNull())
    w = W.partitionBy(job).orderBy(file)
    first = bad.withColumn("_rn", F.row_number().over(w)).where("_rn <= 3")
    line = F.concat(F.col(file), F.lit(": "), F.col(code))
    listed = first.groupBy(job).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", line.alias("l")))), lambda x: x["l"]), "; ").alias("_l"))
    counts = results.groupBy(job).agg(F.count("*").alias("total"), F.count(F.when(F.col(code).isNull(), 1)).alias("done"))
    j = counts.join(listed, job, "left").withColumn("failed", F.col("total") - F.col("done"))
    more = F.when(F.col("failed") > 3, F.concat(F.lit("; +"), (F.col("failed") - 3).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat(F.col("done").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" converted"))
    message = F.when(F.col("failed") == 0, head).otherwise(F.concat(head, F.lit(": "), F.col("_l"), more))
    return j.select(job, "total", "done", "failed", message.alias("message"))
