"""Language tags and votes as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAG = r"\A[A-Za-z]{2,3}(?:-[A-Za-z0-9]{1,8})*\z"
# Codes that name no language.
NO_LANGUAGE = ("und", "zxx", "mis", "mul")


def normalize_lang(tag: Column) -> Column:
    """A language tag in its usual case, '' where it is none: the language in
    small letters, two letters in capitals, four with a first capital."""
    t = F.replace(F.trim(F.coalesce(tag, F.lit(""))), F.lit("_"), F.lit("-"))
    alpha = lambda p, n: p.rlike(rf"\A[A-Za-z]{{{n}}}\z")
    part = lambda p, i: (
        F.when(i == 0, F.lower(p)).when(alpha(p, 2), F.upper(p)).when(alpha(p, 4), F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))).otherwise(F.lower(p))
    )
    first = F.lower(F.substring_index(t, "-", 1))
    out = F.array_join(F.transform(F.split(t, "-", -1), part), "-")
    return F.when(t.rlike(TAG) & ~first.isin(*NO_LANGUAGE), out).otherwise("")


def first_lang(*tags: Column) -> Column:
    """The first tag that is one, '' where none is."""
    out = F.lit("")
    for t in reversed(tags):
        n = normalize_lang(t)
        out = F.when(n != "", n).otherwise(out)
    return out


def lang_or_und(tag: Column) -> Column:
    n = normalize_lang(tag)
    return F.when(n == "", "und").otherwise(n)


HTML_LANG = r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([^"'\s>]+)"""
META_LANG = r"""(?is)<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?([^"'\s>,]+)"""


def html_lang(html: Column) -> Column:
    """The page's language: of its html element, else of a meta element."""
    return first_lang(F.regexp_extract(html, HTML_LANG, 1), F.regexp_extract(html, META_LANG, 1))


# Classes of scripts whose letters vote together.
EAST, RIGHT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", r"[\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}]"


def letters(text: Column) -> Column:
    """(other, east, right): letters of a text by class of script."""
    size = lambda t: F.length(t)
    only = F.regexp_replace(text, r"[^\p{L}]", "")
    east = size(only) - size(F.regexp_replace(only, EAST, ""))
    right = size(only) - size(F.regexp_replace(only, RIGHT, ""))
    return F.struct((size(only) - east - right).alias("other"), east.alias("east"), right.alias("right"))


def top_lang(runs: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    """(key, lang, letters): the language with most letters of a key's runs; runs
    without a language win ties (lang ''), then the smaller tag.

    Letters are counted in the row and summed before the shuffle, so a key with
    many runs costs one row for each of its languages."""
    n = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]", ""))
    counted = runs.groupBy(F.col(key), normalize_lang(F.col(lang)).alias("lang")).agg(F.sum(n).alias("letters"))
    w = W.partitionBy(key).orderBy(F.col("letters").desc(), "lang")
    return counted.where("letters > 0").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def script_langs(runs: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    """(key, other, east, right): per class of scripts the language of most letters,
    '' where unmarked runs have as many, null where the class has no letter."""
    n = letters(F.coalesce(F.col(text), F.lit("")))
    kinds = ("other", "east", "right")
    counted = runs.select(F.col(key), normalize_lang(F.col(lang)).alias("__lang"), n.alias("__n"))
    counted = counted.groupBy(key, "__lang").agg(*[F.sum(f"__n.{k}").alias(k) for k in kinds])
    best = [F.min(F.when(F.col(k) > 0, F.struct((-F.col(k)).alias("n"), "__lang"))).alias(k) for k in kinds]
    return counted.groupBy(key).agg(*best).select(key, *[F.col(f"{k}.__lang").alias(k) for k in kinds])
