"""Text scalars as built-in expressions: HTML to text, escaping, titles, cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = r"(?:[\s/][^>]*)?>"
# HTML to text: (pattern, replacement), applied in order; no lookaround, so any engine runs them.
HTML_STEPS: list[tuple[str, str]] = [
    *[(rf"(?is)<{t}{_END}.*?(?:</{t}{_END}|\z)", "") for t in ("head", "script", "style", "noscript", "template")],
    (r"(?s)<!--.*?-->", ""),
    (rf"(?i)</?br{_END}", "\n"),
    (rf"(?i)</?(?:p|h[1-6]|pre|blockquote|table|ul|ol|hr|title){_END}", "\n\n"),
    (rf"(?i)<(?:div|section|article|header|footer|li|tr|dt|dd){_END}", "\n"),
    (rf"(?i)</(?:td|th){_END}", "\t"),
    (r"<[^>]*>|<[^>]*\z", ""),
]
# The named references that the expression decodes, & last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&#160;": " ", "&copy;": "©", "&reg;": "®",
    "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&bull;": "•", "&euro;": "€", "&trade;": "™",
    "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&times;": "×", "&deg;": "°", "&amp;": "&",
}
SPACE_STEPS: list[tuple[str, str]] = [
    ("\r\n", "\n"),
    (" ", " "),
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t\r\f\v]+\n", "\n\n"),
    (r"\n{3,}", "\n\n"),
    (r"\A\s+|\s+\z", ""),
]


def regexp_steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return text


def html_to_text(html: Column, unescape=None) -> Column:
    """Tags become line breaks or nothing, entities are decoded, blank lines are
    collapsed; the text ends with one line feed unless it is empty.  ``unescape``
    may be a function from column to column for references beyond ENTITIES."""
    text = regexp_steps(html, HTML_STEPS)
    if unescape is not None:
        text = unescape(text)
    else:
        for name, char in ENTITIES.items():
            text = F.replace(text, F.lit(name), F.lit(char))
    text = regexp_steps(text, SPACE_STEPS)
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def first_heading(text: Column, markdown: bool = False) -> Column:
    """The first line with a character, clipped to 80; a Markdown heading loses
    its marks; Document where there is none."""
    line = F.regexp_extract(text, r"(?s)\A\s*([^\n]*[^\s][^\n]*)", 1)
    line = F.regexp_replace(line, r"\A\s+|\s+\z", "")
    if markdown:
        line = F.when(line.startswith("#"), F.regexp_replace(F.regexp_replace(line, r"\A#+", ""), r"\A\s+", "")).otherwise(line)
    return F.when(line == "", "Document").otherwise(F.left(line, F.lit(80)))


def paragraphs(text: Column) -> Column:
    """Paragraphs of plain text: separated by empty lines, without blank ones."""
    plain = F.replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), F.lit("\r\n"), F.lit("\n"))
    cut = F.transform(F.split(plain, "\n\n", -1), lambda p: F.regexp_replace(p, r"\n+\z", ""))
    return F.filter(cut, lambda p: F.regexp_replace(p, r"\s+", "") != "")


PAGE = (
    '<!DOCTYPE html>\n<html{lang}>\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n'
    "<style>body{{font-family:sans-serif;max-width:50em;margin:2em auto;padding:0 1em}}</style>\n</head>\n<body>\n{body}</body>\n</html>\n"
)


def page(title: Column, lang: Column, body: Column) -> Column:
    """A standalone page; an empty language leaves the attribute out."""
    head, rest = PAGE.replace("{{", "{").replace("}}", "}").split("{lang}")
    mid, rest = rest.split("{title}")
    tail, end = rest.split("{body}")
    attribute = F.when(F.coalesce(lang, F.lit("")) == "", "").otherwise(F.concat(F.lit(' lang="'), html_escape(lang), F.lit('"')))
    return F.concat(F.lit(head), attribute, F.lit(mid), html_escape(title), F.lit(tail), body, F.lit(end))


def text_to_html(text: Column, lang: Column) -> Column:
    """Plain text as a page of paragraphs with hard line breaks."""
    body = F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), F.replace(html_escape(p), F.lit("\n"), F.lit("<br>\n")), F.lit("</p>\n")))
    return page(first_heading(text), lang, F.array_join(body, ""))


def cell_string(value: Column, kind: str) -> Column:
    """A value as a table cell: nothing for null, no exponent, no needless zeros."""
    text = value.cast("string")
    if kind in ("double", "float"):
        exact = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", "")
        text = F.when(text.contains("E"), F.coalesce(exact, text)).otherwise(F.regexp_replace(text, r"\.0$", ""))
    elif kind.startswith("decimal"):
        text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)
    elif kind.startswith(("array", "struct", "map")):
        text = F.to_json(value)
    return F.coalesce(text, F.lit(""))


def quoted(cell: Column, delimiter: str) -> Column:
    """A delimited field, quoted where it must be."""
    must = cell.rlike(rf'[{delimiter}"\r\n]|\A\s') | (cell == "\\.")
    return F.when(must, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def markdown_cell(cell: Column) -> Column:
    """A table cell: marks escaped, line feeds as <br>."""
    out = F.regexp_replace(cell, r"([\\*_`\[\]<|])", r"\\$1")
    return F.regexp_replace(out, r"\r?\n", "<br>")


def is_numeric_cell(cell: Column) -> Column:
    """Whether a spreadsheet stores the cell as a number: at most 20 characters,
    a plain decimal without a leading zero, at most 15 digits."""
    plain = cell.rlike(r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z") & (F.length(cell) <= 20)
    return plain & (F.length(F.regexp_replace(cell, r"[^0-9]", "")) <= 15)


def column_name(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters."""
    i = index.cast("int")
    letter = lambda n: F.char(F.lit(65) + n)
    two, three = F.floor(i / 26) - 1, F.floor((i - 26) / 676) - 1
    return F.concat(
        F.when(i >= 702, letter(three.cast("int"))).otherwise(""),
        F.when(i >= 702, letter(F.pmod(two, F.lit(26)).cast("int"))).when(i >= 26, letter(two.cast("int"))).otherwise(""),
        letter(F.pmod(i, F.lit(26))),
    )


def xml_name(name: Column) -> Column:
    """An element name: other characters become _, what can't begin one goes."""
    out = F.regexp_replace(name, r"\A[^\p{L}_]+", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{Nd}_.\-]", "_")
    return F.when(out == "", "item").when(F.lower(out).startswith("xml"), F.concat(F.lit("_"), out)).otherwise(out)
