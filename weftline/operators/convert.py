"""The registry of built-in conversions, and conversion of files as a DataFrame transform.

Every pair of the catalogue's built-in edges has an entry: a function of a file's
bytes.  Files are rows; a file that can't be read is a row with an error code, and
never fails the others.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator, Mapping
from functools import cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.codecs import Unreadable, archives, blocks, fonts, images, office, pdf, photos, trees, webp
from weftline.operators.jobs import size_code
from weftline.plans.catalog import GROUPS, KNOB_RANGES, edges

Convert = Callable[[bytes, Mapping[str, str]], bytes]
READ_PICTURE = {**images.READERS, "jpg": photos.read_jpg, "gif": photos.read_gif, "tiff": photos.read_tiff, "webp": webp.read_webp}
WRITE_PICTURE = {**images.WRITERS, "jpg": photos.write_jpg, "gif": photos.write_gif, "tiff": photos.write_tiff, "webp": webp.write_webp}


def lang_of(options: Mapping[str, str]) -> str:
    return office.tag(options.get("locale", ""))


READ_DOCUMENT: dict[str, Callable[[bytes], blocks.Document]] = {
    "md": blocks.read_markdown, "html": blocks.read_html, "txt": blocks.read_text, "docx": office.read_docx, "odt": office.read_odt,
    "rtf": office.read_rtf, "pptx": office.read_pptx, "epub": office.read_epub,
}
WRITE_DOCUMENT: dict[str, Callable[[blocks.Document], bytes]] = {
    "md": blocks.write_markdown, "html": blocks.write_html, "txt": blocks.write_text, "pdf": pdf.write_document, "docx": office.write_docx, "epub": office.write_epub,
}
READ_ROWS: dict[str, Callable[[bytes], list[list[str]]]] = {
    "csv": lambda x: trees.read_delimited(x, ","), "tsv": lambda x: trees.read_delimited(x, "\t"), "xlsx": office.read_xlsx, "ods": office.read_ods,
    **{k: (lambda x, r=r: trees.rows_of(r(x))) for k, r in trees.TREE_READERS.items()},
}


def _records_json(rows: list[list[str]]) -> bytes:
    return trees.write_json(trees.records(rows))


WRITE_ROWS: dict[str, Callable[[list[list[str]]], bytes]] = {
    "csv": lambda r: trees.write_delimited(r, ","), "tsv": lambda r: trees.write_delimited(r, "\t"), "xlsx": office.write_xlsx,
    "json": _records_json, "yaml": lambda r: trees.write_yaml(trees.records(r)),
    "md": lambda r: blocks.write_markdown(blocks.from_rows(r)), "html": lambda r: blocks.write_html(blocks.from_rows(r)),
}


def _document(src: str, dst: str) -> Convert:
    def run(raw: bytes, options: Mapping[str, str]) -> bytes:
        d = READ_DOCUMENT[src](raw)
        d.lang = office.tag(d.lang) or lang_of(options)
        return WRITE_DOCUMENT[dst](d)

    return run


def _number(options: Mapping[str, str], knob: str) -> int:
    lo, hi, default = KNOB_RANGES[knob]
    text = options.get(knob, "").strip()
    return min(max(int(text), lo), hi) if re.fullmatch(r"-?\d{1,9}", text) else default


def _picture(src: str, dst: str) -> Convert:
    def run(raw: bytes, options: Mapping[str, str]) -> bytes:
        if src == "jpg" and dst == "pdf":  # the picture's own bytes, whatever its kind of JPEG
            return pdf.write_pictures([raw])
        if src == "jpg" and dst == "svg":
            return images.svg(raw, "jpeg", *pdf.jpeg_size(raw)[:2])
        p = READ_PICTURE[src](raw)
        if dst == "pdf":
            return pdf.write_pictures([p])
        if dst == "svg":
            return images.svg(raw if src == "png" else images.write_png(p), "png", p.shape[1], p.shape[0])
        if dst == "txt":
            return images.to_text(p)
        if dst == "ico":
            return images.write_ico(p, options.get("icon_sizes", "favicon"))
        return photos.write_jpg(p, _number(options, "quality")) if dst == "jpg" else WRITE_PICTURE[dst](p)

    return run


def html_text(raw: bytes) -> bytes:
    """HTML to text by the steps of the SQL expression, with every reference decoded."""
    from weftline.functions.text import HTML_STEPS, SPACE_STEPS

    t = trees.text_of(raw)
    for pattern, put in HTML_STEPS:
        t = re.sub(pattern.replace(r"\z", r"\Z"), put, t)
    t = entities.unescape(t)
    for pattern, put in SPACE_STEPS:
        t = re.sub(pattern.replace(r"\z", r"\Z"), put, t)
    return (t + "\n" * bool(t)).encode()


def text_html(raw: bytes, options: Mapping[str, str]) -> bytes:
    from weftline.functions.text import PAGE

    text = trees.text_of(raw).replace("\r\n", "\n")
    paragraphs = [p.rstrip("\n") for p in text.split("\n\n")]
    esc = lambda x: entities.escape(x, quote=False).replace("'", "&#39;").replace('"', "&#34;")
    body = "".join("<p>" + esc(p).replace("\n", "<br>\n") + "</p>\n" for p in paragraphs if p.strip())
    title = next((x.strip()[:80] for x in text.split("\n") if x.strip()), "Document")
    lang = lang_of(options)
    return PAGE.format(lang=f' lang="{lang}"' if lang else "", title=esc(title), body=body).encode()


CUE_TIME = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})")


def cues(raw: bytes) -> list[tuple[int, int, str]]:
    out = []
    for block in re.split(r"\n[ \t]*\n+", trees.text_of(raw).replace("\r\n", "\n")):
        m = re.search(r"^([^\n]*?)-->[ \t]*([^\n]*)(?:\n(.*))?\Z", block, re.S | re.M)
        a, b = (CUE_TIME.match(x.strip()) for x in m.groups()[:2]) if m else (None, None)
        if a and b:
            ms = [((int(t[1] or 0) * 60 + int(t[2])) * 60 + int(t[3])) * 1000 + int(t[4].ljust(3, "0")) for t in (a, b)]
            out.append((ms[0], ms[1], (m[3] or "").strip("\n").rstrip()))
    if not out:
        raise Unreadable("no cues")
    return out


def _clock(ms: int, sep: str) -> str:
    return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02}{sep}{ms % 1000:03}"


def subtitle(dst: str) -> Convert:
    def strip(t: str, every: bool) -> str:
        tags = "c|v|ruby|rt|lang" + ("|b|i|u|s|font" if every else "")
        return entities.unescape(re.sub(rf"(?i)</?(?:{tags})\b[^>]*>", "", t))

    def run(raw: bytes, _: Mapping[str, str]) -> bytes:
        found = cues(raw)
        if dst == "txt":
            return ("\n".join(strip(t, True) for *_, t in found) + "\n").encode()
        if dst == "srt":
            return "\n".join(f"{i}\n{_clock(a, ',')} --> {_clock(b, ',')}\n{strip(t, False)}\n" for i, (a, b, t) in enumerate(found, 1)).encode()
        web = lambda t: re.sub(r"(?i)</font\s*>", "</c>", re.sub(r"(?i)<font\b[^>]*>", "<c>", t.replace("&", "&amp;")))
        return ("WEBVTT\n\n" + "\n".join(f"{_clock(a, '.')} --> {_clock(b, '.')}\n{web(t)}\n" for a, b, t in found)).encode()

    return run


def _font(src: str, dst: str) -> Convert:
    return lambda raw, _: fonts.to_woff(raw) if dst == "woff" else fonts.from_woff(raw) if src == "woff" else fonts.relabel(raw)


@cache
def registry() -> dict[tuple[str, str], Convert]:
    """A function for each built-in edge of the catalogue."""
    coded, packed = set(GROUPS["coded"].split()), set(GROUPS["packed"].split())
    direct: dict[tuple[str, str], Convert] = {
        ("html", "txt"): lambda raw, _: html_text(raw),
        ("txt", "html"): text_html,
        ("txt", "md"): lambda raw, _: raw,
    }
    out: dict[tuple[str, str], Convert] = {}
    for e in edges():
        if e.engine:
            continue
        s, t = e.src, e.dst
        if (s, t) in direct:
            f = direct[s, t]
        elif t in packed and s in packed:
            f = lambda raw, _, s=s, t=t: archives.write(archives.read(raw, s), t)
        elif t in packed:
            f = lambda raw, o, t=t: archives.pack_one(raw, o.get("source_name", ""), t)
        elif s in coded:
            f = _picture(s, t)
        elif s in ("srt", "vtt"):
            f = subtitle(t)
        elif s in ("ttf", "otf", "woff"):
            f = _font(s, t)
        elif s in trees.TREE_READERS and t in trees.TREE_WRITERS:
            f = lambda raw, _, s=s, t=t: trees.TREE_WRITERS[t](trees.TREE_READERS[s](raw))
        elif s in READ_ROWS and t in WRITE_ROWS and not (s in READ_DOCUMENT):
            f = lambda raw, _, s=s, t=t: WRITE_ROWS[t](READ_ROWS[s](raw))
        else:
            f = _document(s, t)
        out[s, t] = f
    return out


def convert_bytes(raw: bytes, path: list[str], options: Mapping[str, str]) -> bytes:
    """A file along a route of formats."""
    steps = registry()
    for s, t in zip(path, path[1:], strict=False):
        raw = steps[s, t](raw, options)
    return raw


def convert(files: DataFrame, content: str, path: str, options: str | None = None, name: str | None = None) -> DataFrame:
    """Adds result (binary), error_code and detail.

    path: a column of the formats of a route, source first; rows without one pass
    as they are.  Contents beyond the limit are too_large before they reach Python;
    options: a map<string,string> column; name: the source's name for packing.
    Rows map one to one, without a shuffle."""
    spark = files.sparkSession
    code = size_code(F.octet_length(content))
    staged = files.select(
        "*",
        F.when(code.isNull(), F.col(content)).alias("__raw"),
        F.array_join(path, "\n", "").alias("__path"),  # one text a route: far fewer routes than files
        *([F.col(options).alias("__options")] if options else []),
        *([F.col(name).alias("__name")] if name else []),
        code.alias("__code"),
    )
    own = files.columns
    schema = files.schema.add("result", "binary").add("error_code", "string").add("detail", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes: dict[str, list[str]] = {}
        for b in batches:
            made: list[tuple[bytes | None, str | None, str | None]] = []
            get = {k: b.column(f"__{k}").to_pylist() if f"__{k}" in b.schema.names else repeat(None, b.num_rows) for k in ("raw", "path", "options", "name", "code")}
            for raw, route, opts, label, code in zip(*(get[k] for k in ("raw", "path", "options", "name", "code")), strict=True):
                if code or raw is None or not route:
                    made.append((None, code or ("read_failed" if raw is None else "no_route"), None))
                    continue
                try:
                    made.append((convert_bytes(bytes(raw), routes.get(route) or routes.setdefault(route, route.split("\n")), dict(opts or {}) | {"source_name": label or ""}), None, None))
                except KeyError as e:
                    made.append((None, "no_route", str(e)))
                except Exception as e:  # any fault of one file's parser is that row's error
                    made.append((None, "convert_failed", f"{type(e).__name__}: {e}"[:200]))
            cols = [b.column(c) for c in own] + [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True) if made else ([], [], []), (pa.binary(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    for key, most in (("maxRecordsPerBatch", 1024), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return staged.mapInArrow(run, schema)


def route_path(keys: "F.Column") -> "F.Column":
    """The formats of a route's edge keys, source first."""
    src = F.transform(F.slice(keys, F.lit(1), F.lit(1)), lambda k: F.substring_index(k, ">", 1))
    return F.concat(src, F.transform(keys, lambda k: F.substring_index(F.substring_index(k, "@", 1), ">", -1)))


def unpack(files: DataFrame, key: str, content: str, fmt: str) -> DataFrame:
    """(key, entry, is_dir, size, data, error_code): an archive's entries, a row
    each; an archive that can't be read is one row with error_code unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw, f in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    found = archives.read(raw or b"", f)
                    made = ((e.name, e.is_dir, len(e.data), e.data, None) for e in found)
                except Unreadable:
                    made = iter([(None, None, None, None, "unreadable")])
                for row in made:
                    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()], k.type), *(pa.array([x], t) for x, t in zip(row, kinds, strict=True))],
                        [key, "entry", "is_dir", "size", "data", "error_code"],
                    )

    kind = files.select(key).schema[0].dataType.simpleString()
    return files.select(key, content, fmt).mapInArrow(run, f"{key} {kind}, entry string, is_dir boolean, size long, data binary, error_code string")


def pack(files: DataFrame, archive: str, name: str, content: str, fmt: str, order: str, part_bytes: int = 32 << 20, part_entries: int = archives.MAX_ENTRIES // 2) -> DataFrame:
    """(archive, part, n_entries, data): files of an archive as archive files of at
    most about ``part_bytes`` and ``part_entries`` each, so that no archive is one
    task's memory or more than a reader takes.

    Parts come from running sizes within (archive, hash bucket of its files), whose
    number follows the archive's total size and files."""
    from weftline.operators.jobs import pack_names

    named = pack_names(files, archive, name, order).withColumn("__size", F.octet_length(content))
    total = named.groupBy(archive).agg(F.greatest(F.ceil(F.sum("__size") / part_bytes), F.ceil(F.count("*") / part_entries)).alias("__parts"))
    dealt = named.join(total, archive).withColumn("part", F.pmod(F.xxhash64("entry"), F.greatest(F.col("__parts"), F.lit(1))).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("entry").to_pylist(), t.column("__data").to_pylist(), strict=True))
        data = archives.write([archives.Entry(n, d or b"") for n, d in rows], fmt)
        return pa.table({archive: t.column(archive)[:1], "part": t.column("part")[:1], "n_entries": pa.array([len(rows)], pa.int64()), "data": pa.array([data], pa.binary())})

    kind = files.select(archive).schema[0].dataType.simpleString()
    few = dealt.select(archive, "part", "entry", F.col(content).cast("binary").alias("__data"))
    return few.groupBy(archive, "part").applyInArrow(run, f"{archive} {kind}, part int, n_entries long, data binary")
