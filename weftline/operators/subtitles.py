"""Subtitles: cue parsing and the three text forms, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"


def clock_ms(text: Column) -> Column:
    """Milliseconds of H:MM:SS,mmm or MM:SS.mmm; null where it is none."""
    part = lambda i: F.regexp_extract(text, rf"\A\s*{CLOCK}", i)
    hours = F.coalesce(part(1).try_cast("long"), F.lit(0))
    ms = F.rpad(part(4), 3, "0").try_cast("long")
    return ((hours * 60 + part(2).try_cast("long")) * 60 + part(3).try_cast("long")) * 1000 + ms


def clock_text(ms: Column, separator: str) -> Column:
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    s = F.floor(ms / 1000)
    return F.concat(
        two(F.floor(s / 3600)), F.lit(":"), two(F.pmod(F.floor(s / 60), F.lit(60))), F.lit(":"), two(F.pmod(s, F.lit(60))),
        F.lit(separator), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"),
    )


def parse_cues(text: Column) -> Column:
    """array<struct<start_ms, end_ms, text>> of an SRT or VTT text; blocks without
    a readable time line are skipped."""
    plain = F.replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), F.lit("\r\n"), F.lit("\n"))
    line = r"(?m)^([^\n]*?)-->[ \t]*([^\n]*)$"

    def cue(block: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(block, r"(?s)-->[^\n]*\n(.*)\z", 1), r"\A\n+|\s+\z", "")
        return F.struct(
            clock_ms(F.regexp_extract(block, line, 1)).alias("start_ms"), clock_ms(F.regexp_extract(block, line, 2)).alias("end_ms"), body.alias("text")
        )

    cut = F.transform(F.filter(F.split(plain, r"\n[ \t]*\n+", -1), lambda b: b.contains("-->")), cue)
    return F.filter(cut, lambda c: c["start_ms"].isNotNull() & c["end_ms"].isNotNull())


def plain_cue(text: Column, all_tags: bool) -> Column:
    """Cue text without the tags that SRT doesn't know; without any for plain text."""
    tags = r"(?i)</?(?:c|v|ruby|rt|lang|b|i|u|s|font)\b[^>]*>" if all_tags else r"(?i)</?(?:c|v|ruby|rt|lang)\b[^>]*>"
    out = F.regexp_replace(text, tags, "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def vtt_cue(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(F.regexp_replace(out, r"(?i)<font\b[^>]*>", "<c>"), r"(?i)</font\s*>", "</c>")


def srt_line(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), clock_text(start, ","), F.lit(" --> "), clock_text(end, ","), F.lit("\n"), text, F.lit("\n"))


def vtt_line(start: Column, end: Column, text: Column) -> Column:
    return F.concat(clock_text(start, "."), F.lit(" --> "), clock_text(end, "."), F.lit("\n"), vtt_cue(text), F.lit("\n"))


def srt(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda c, i: srt_line(i + 1, c["start_ms"], c["end_ms"], plain_cue(c["text"], False))), "\n")


def vtt(cues: Column) -> Column:
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(cues, lambda c: vtt_line(c["start_ms"], c["end_ms"], c["text"])), "\n"))


def cues_text(cues: Column) -> Column:
    return F.concat(F.array_join(F.transform(cues, lambda c: plain_cue(c["text"], True)), "\n"), F.lit("\n"))


def convert(files: DataFrame, src: str, dst: str, content: str = "text") -> DataFrame:
    """Adds result and error_code: a text without cues is a row's error."""
    made = files.withColumn("_c", parse_cues(F.col(content)))
    form = {"srt": srt, "vtt": vtt, "txt": cues_text}[dst](F.col("_c"))
    ok = F.size("_c") > 0
    return made.withColumns({"result": F.when(ok, form), "error_code": F.when(~ok, "convert_failed")}).drop("_c")
