"""Line-first cleaning with Spark SQL functions only.

Each line is judged by a punctuation, a navigation and a boilerplate rule; failing
lines are removed, and a document that loses more than ``max_loss`` percent of its
word characters that way is rejected, as is one that fails the base rules on its
word count and on words in repeated 5-word windows (equal where their 64-bit hashes
are).  Everything is one projection
over the row's own text: nothing is shuffled, and a document of any length is one
row's work, linear but for the sort of its window hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Fixed values of the line rules.
TERMINAL = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x{22}\x{27}\x29\x5D\x{BB}\x{2019}\x{201D}]*[\x20\x09-\x0D]*$"
MARKS = r"[!#*$%&<>^~=+@\x5C]"
SEPARATORS = r"[|\x{BB}\x{203A}\x{2022}\x{B7}]"
# In four languages; other letters than a to z are in both cases, as engines differ in theirs.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses? cookies"
    r"|enable javascript|sign (in|up)|log in|subscribe|newsletter|click here|read more|share (on|this)|lorem ipsum|copyright \d{4}"
    r"|alle rechte vorbehalten|nutzungsbedingungen|impressum|verwendet cookies|hier klicken|jetzt anmelden|mehr lesen|teilen auf"
    r"|tous droits r[\x{E9}\x{C9}]serv[\x{E9}\x{C9}]s|conditions d'utilisation|mentions l[\x{E9}\x{C9}]gales|utilise des cookies|cliquez ici|se connecter|lire la suite|partager sur"
    r"|todos los derechos reservados|condiciones de uso|aviso legal|pol[\x{ED}\x{CD}]tica de privacidad|utiliza cookies|haga clic|iniciar sesi[\x{F3}\x{D3}]n|compartir en)\b"
)
#: A line without terminal punctuation fails below so many words.
SHORT_LINE = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: as the argument of a lambda."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more."""

    def of(windows: Column) -> Column:
        dealt = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            other = lambda k: F.coalesce(F.get(s, k)["h"], F.lit(None))
            hit = F.filter(s, lambda x, k: F.coalesce(x["h"] == other(k - 1), F.lit(False)) | F.coalesce(x["h"] == other(k + 1), F.lit(False)))
            at = F.array_sort(F.transform(hit, lambda x: x["i"]))
            return _let(
                at,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, x: a + x
                ),
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(dealt, twice))

    last = F.size(words) - 5
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(last < 1, 0).otherwise(_let(windows, of)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    """Characters of a one-character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the three rules."""
    words = F.regexp_count(line, F.lit(WORD))

    def judge(n: Column) -> Column:
        punctuation = (2 * _count(line, MARKS) >= n) | ((n < SHORT_LINE) & ~line.rlike(TERMINAL))
        navigation = _let(_count(line, SEPARATORS), lambda s: (s >= 3) & (3 * s >= n))
        return punctuation | navigation | line.rlike(BOILERPLATE)

    return _let(words, judge)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, removed_chars, clean_text), a row per input row.

    clean_text is the text without failing lines and without lines that have no
    word.  Null and empty texts have no words, so they fail the base rules;
    repeated rows get equal results; null doc_ids pass; further columns are
    ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    chars = lambda x: F.length(F.regexp_replace(x, SPACE, ""))
    words = F.filter(F.split(text, SPACE, -1), lambda x: x != "")

    def judged(all_lines: Column) -> Column:
        good = F.filter(all_lines, lambda x: ~line_fails(x))
        dups = (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long")
        return F.struct(dups.alias("dups"), F.array_join(good, "\n").alias("clean"))

    counted = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        chars(text).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        _let(words, counted).alias("w"),
        _let(lines, judged).alias("l"),
    )
    failed = (F.col("w.n") < 10) | (100 * F.col("w.repeat") > 20 * F.col("w.n"))
    out = out.select("*", failed.alias("base_failed"), (F.col("word_chars") - chars(F.col("l.clean"))).alias("removed_chars"))
    return out.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dups").alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"),
        "base_failed",
        (~F.col("base_failed") & (100 * F.col("removed_chars") <= max_loss * F.col("word_chars"))).alias("kept"),
        "removed_chars",
        F.col("l.clean").alias("clean_text"),
    )
