"""Office packages: documents and sheets in zipped XML, and rich text."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from functools import cache, lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from . import Unreadable
from .blocks import CODE, HEADING, ITEM, PARAGRAPH, QUOTE, RULE, TABLE, Block, Document, Span, body_html, merged, plain, read_html, title_of

# Limits of a part and of a sheet, repeats that are expanded, and the date that packages carry.
MAX_PART, MAX_COLUMNS, MAX_ROWS, MAX_REPEAT, MODIFIED = 64 << 20, 16384, 1 << 20, 1000, "2000-01-01T00:00:00Z"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(e: ElementTree.Element | None, name: str, default: str = "") -> str:
    """An attribute by its name without namespace."""
    if e is not None:
        for k, v in e.attrib.items():
            if local(k) == name:
                return v
    return default


def child(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for p in path:
        e = next((c for c in e if local(c.tag) == p), None) if e is not None else None
    return e


ZIP_LOCAL, ZIP_CENTRAL, ZIP_END = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"  # of 30, 46 and 22 bytes


def _directory(raw: bytes) -> dict[str, tuple] | None:
    """(method, crc, packed size, size, offset, name) of a plain zip file's parts;
    None where anything is unusual, which zipfile then sorts out."""
    end = len(raw) - 22
    if end < 0 or raw[end : end + 4] != b"PK\5\6":
        return None
    _, disk, first, here, n, size, at, comment = struct.unpack_from(ZIP_END, raw, end)
    if disk or first or comment or here != n or n == 0xFFFF or at + size != end:
        return None
    out: dict[str, tuple] = {}
    low, lists = 0, at
    for _ in range(n):
        if at + 46 > end:
            return None
        mark, _, _, flags, method, _, _, crc, packed, length, named, extra, said, disk, _, _, start = struct.unpack_from(ZIP_CENTRAL, raw, at)
        at += 46
        name = raw[at : at + named]
        if mark != b"PK\1\2" or flags & ~6 or method not in (0, 8) or extra or said or disk or start < low or not name.isascii() or b"\0" in name:
            return None
        low = start + 30 + named + packed
        out[name.decode().lower().lstrip("/")] = method, crc, packed, length, start, name
        at += named
    return out if at == end and low <= lists else None


def _part(raw: bytes, method: int, crc: int, packed: int, length: int, start: int, name: bytes) -> bytes | None:
    """A part of a plain zip file; None where it isn't what its directory says."""
    if length > MAX_PART or start + 30 > len(raw):
        return None
    mark, _, flags, kind, _, _, _, _, _, named, extra = struct.unpack_from(ZIP_LOCAL, raw, start)
    at = start + 30
    if mark != b"PK\3\4" or flags & ~6 or kind != method or extra or raw[at : at + named] != name:
        return None
    at += named
    data = raw[at : at + packed]
    if method:
        z = zlib.decompressobj(-15)
        try:
            data = z.decompress(data, length + 1)
        except zlib.error:
            return None
        if not z.eof or z.unused_data:
            return None
    return data if len(data) == length and zlib.crc32(data) == crc else None


def _parsed(data: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Unreadable(str(e)) from None


def _targets(rels: ElementTree.Element | None, folder: str) -> dict[str, str]:
    return {attr(r, "Id"): attr(r, "Target") if attr(r, "TargetMode") == "External" else posixpath.normpath(posixpath.join(folder, attr(r, "Target"))).lstrip("/") if not attr(r, "Target").startswith("/") else attr(r, "Target").lstrip("/") for r in (rels if rels is not None else ())}


class Package:
    """Parts of a zip file by name in any case.

    Plain files are read as they lie; zipfile reads the others, and whatever does
    not fit its directory, so that its checks and errors hold."""

    def __init__(self, raw: bytes):
        self.raw, self.plain = raw, _directory(raw)
        if self.plain is None:
            self.names = self._infos()
        else:
            self.names = self.plain

    def _infos(self) -> dict:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(self.raw))
        except (zipfile.BadZipFile, ValueError, EOFError) as e:
            raise Unreadable(str(e)) from None
        return {i.filename.lower().lstrip("/"): i for i in self.zip.infolist()}

    def bytes(self, name: str) -> bytes | None:
        i = self.names.get(name.lower().lstrip("/"))
        if i is None:
            return None
        if self.plain is not None:
            data = _part(self.raw, *i)
            if data is not None:
                return data
            self.plain, self.names = None, self._infos()
            i = self.names[name.lower().lstrip("/")]
        with self.zip.open(i) as f:
            data = f.read(MAX_PART + 1)
        if len(data) > MAX_PART:
            raise Unreadable(f"{name} is too large")
        return data

    def xml(self, name: str, need: bool = False) -> ElementTree.Element | None:
        data = self.bytes(name)
        if data is None:
            if need:
                raise Unreadable(f"{name} is missing")
            return None
        return _parsed(data)

    def relations(self, name: str) -> dict[str, str]:
        folder, base = posixpath.split(name)
        rels = self.xml(f"{folder}/_rels/{base}.rels".lstrip("/"))
        return _targets(rels, folder)


def zipped(parts: list[tuple[str, str | bytes]], stored: str = "", lead: bytes = b"") -> bytes:
    """A package with fixed times, ``lead`` being its first parts; the part called
    ``stored`` isn't compressed."""
    out = io.BytesIO(lead)
    with zipfile.ZipFile(out, "a" if lead else "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            i = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            i.compress_type = zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED
            z.writestr(i, data)
    return out.getvalue()


def zipped_after(lead: bytes, name: str, data: bytes) -> bytes:
    """``zipped`` of one part after ``lead``, without reading and writing that anew."""
    if len(data) >= 1 << 31:
        return zipped([(name, data)], lead=lead)
    *_, n, size, at, _ = struct.unpack_from(ZIP_END, lead, len(lead) - 22)
    z = zlib.compressobj(-1, zlib.DEFLATED, *((-12, 5) if len(data) <= 4096 else (-15, 8)))  # a small part needs no more window and memory
    packed, label = z.compress(data) + z.flush(), name.encode()
    same = 0, 8, 0, 33, zlib.crc32(data), len(packed), len(data), len(label), 0  # 33: the 1st of January 1980
    local = struct.pack(ZIP_LOCAL, b"PK\3\4", 20, *same) + label + packed
    central = struct.pack(ZIP_CENTRAL, b"PK\1\2", 0x314, 20, *same, 0, 0, 0, 0o600 << 16, at) + label
    end = struct.pack(ZIP_END, b"PK\5\6", 0, 0, n + 1, n + 1, size + len(central), at + len(local), 0)
    return b"".join((lead[:at], local, lead[at : at + size], central, end))


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
CONTENT, RELS = "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


XML_UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f&<>\"]")


def xml_text(s: str) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s), {'"': "&quot;"}) if XML_UNSAFE.search(s) else s


def _types(extra: str) -> str:
    return f'{HEAD}<Types xmlns="{CONTENT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{extra}</Types>'


def _rels(items: list[tuple[str, str, str]]) -> str:
    return f'{HEAD}<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{xml_text(to)}"{" TargetMode=" + chr(34) + "External" + chr(34) if "hyperlink" in t else ""}/>' for i, t, to in items) + "</Relationships>"


# ---- sheets


@lru_cache(256)
def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def column_index(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


NUMERIC, SHOWN = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?"), re.compile(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?")
SHEET_XML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORKBOOK, SHEET, SHEET_HEAD, SHEET_TAIL = "xl/workbook.xml", "xl/worksheets/sheet1.xml", f'{HEAD}<worksheet xmlns="{SHEET_XML}"><sheetData>', "</sheetData></worksheet>"


def numeric(cell: str) -> bool:
    return len(cell) <= 20 and bool(NUMERIC.fullmatch(cell)) and (len(cell) <= 15 or sum(c.isdigit() for c in cell) <= 15)


@cache
def _workbook() -> bytes:
    """The parts of every workbook, without its sheet."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    fonts = '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    styles = f'{HEAD}<styleSheet xmlns="{SHEET_XML}">{fonts}<fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
    over = "".join(f'<Override PartName="/xl/{p}" ContentType="{kind}{t}+xml"/>' for p, t in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("styles.xml", "styles")))
    return zipped(
        [
            ("[Content_Types].xml", _types(over)),
            ("_rels/.rels", _rels([("rId1", f"{OFFICE}/officeDocument", "xl/workbook.xml")])),
            ("xl/workbook.xml", f'{HEAD}<workbook xmlns="{SHEET_XML}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", _rels([("rId1", f"{OFFICE}/worksheet", "worksheets/sheet1.xml"), ("rId2", f"{OFFICE}/styles", "styles.xml")])),
            ("xl/styles.xml", styles),
        ]
    )


def write_xlsx(rows: list[list[str]]) -> bytes:
    out = [SHEET_HEAD]
    for i, r in enumerate(rows, 1):
        style = "" if i > 1 else ' s="1"'
        out.append(f'<row r="{i}">')
        for j, v in enumerate(r):
            if i > 1 and numeric(v):
                out.append(f'<c r="{column_name(j)}{i}"><v>{v}</v></c>')
            elif v:
                out.append(f'<c r="{column_name(j)}{i}"{style} t="inlineStr"><is><t xml:space="preserve">{xml_text(v)}</t></is></c>')
        out.append("</row>")
    out.append(SHEET_TAIL)
    return zipped_after(_workbook(), SHEET, "".join(out).encode())


def _runs(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")


def shown(text: str) -> str:
    """A number cell's text."""
    from .trees import number

    if not SHOWN.fullmatch(text):
        return text
    f = float(text)
    return number(f) if f.is_integer() else repr(f) if "e" not in repr(f) else number(f)


PLAIN_CELL = re.compile(r'(<c r="([A-Z]{1,3})[0-9]+"(?: s="1")?(?:>(<)v>([^<]*)</v>| t="inlineStr"><is><t xml:space="preserve">([^<]*)</t></is>)</c>|<row r="[0-9]+">|</row>)')
NOT_PLAIN = bytes({*range(32), ord("&")} - {9, 10})


@lru_cache(256)
def _index(letters: str) -> int:
    return column_index(letters)


@lru_cache(4096)
def _short_shown(text: str) -> str:
    return shown(text)


def _plain_rows(data: bytes) -> list[list[str]] | None:
    """The rows of a sheet that is made like ``write_xlsx``'s, without references or
    anything that the XML parser would change or refuse; None for any other."""
    if len(data.translate(None, NOT_PLAIN)) != len(data) or b"]]>" in data or b"\xef\xbf" in data:  # the latter: U+FFFE and U+FFFF too
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if not (text.startswith(SHEET_HEAD) and text.endswith(SHEET_TAIL)):
        return None
    out: list[list[str]] = []
    line: list[str] | None = None
    found, left = PLAIN_CELL.findall(text, len(SHEET_HEAD), len(text) - len(SHEET_TAIL)), len(text) - len(SHEET_HEAD) - len(SHEET_TAIL)
    for whole, column, number, v, inline in found:
        left -= len(whole)  # nothing may lie between
        if column:
            c = _index(column)
            if line is None or c >= MAX_COLUMNS or len(out) >= MAX_ROWS:
                return None
            line += [""] * (c - len(line))
            line[c:] = [inline if not number else _short_shown(v) if len(v) <= 32 else shown(v)]
        elif whole == "</row>":
            if line is None:
                return None
            out.append(line)
            line = None
        elif line is not None:
            return None
        else:
            line = []
    return out if not left and line is None else None


@lru_cache(64)
def _first_sheet(book: bytes | None, rels: bytes | None) -> str:
    """The part of a workbook's first sheet."""
    if book is None:
        raise Unreadable(f"{WORKBOOK} is missing")
    first = child(_parsed(book), "sheets", "sheet")
    targets = _targets(_parsed(rels) if rels is not None else None, "xl")
    return targets.get(next((v for k, v in (first.attrib if first is not None else {}).items() if k.endswith("}id")), ""), SHEET)


def read_xlsx(raw: bytes) -> list[list[str]]:
    """The first sheet: shared and inline text, TRUE and FALSE, numbers; gaps by
    the cells' references, rows in their order."""
    p = Package(raw)
    book, rels = p.bytes(WORKBOOK), p.bytes("xl/_rels/workbook.xml.rels")
    small = len(book or b"") + len(rels or b"") <= 8192  # larger ones aren't remembered
    name = (_first_sheet if small else _first_sheet.__wrapped__)(book, rels)
    data = p.bytes(name)
    if data is None:
        raise Unreadable(f"{name} is missing")
    plain_rows = _plain_rows(data)
    if plain_rows is not None:
        return plain_rows
    sheet = _parsed(data)
    strings = p.xml("xl/sharedStrings.xml")
    shared = [_runs(s) for s in strings if local(s.tag) == "si"] if strings is not None else []
    out: list[list[str]] = []
    data = child(sheet, "sheetData")
    for row in data if data is not None else ():
        line: list[str] = []
        for c in row:
            ref, kind, v = attr(c, "r"), attr(c, "t"), child(c, "v")
            at = column_index(ref) if ref else len(line)
            if at >= MAX_COLUMNS or len(out) >= MAX_ROWS:
                raise Unreadable("too large a sheet")
            text = (v.text or "") if v is not None else ""
            if kind == "s":
                text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
            elif kind == "inlineStr":
                text = _runs(c)
            elif kind == "b":
                text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
            elif kind in ("", "n"):
                text = shown(text)
            line += [""] * (at - len(line))
            line[at:] = [text]
        out.append(line)
    return out


def _odf_text(e: ElementTree.Element, skip: tuple[str, ...] = ("annotation", "tracked-changes")) -> str:
    out = e.text or ""
    for c in e:
        name = local(c.tag)
        if name == "s":
            out += " " * int(attr(c, "c", "1") or 1)
        elif name in ("tab", "line-break"):
            out += "\t" if name == "tab" else "\n"
        elif name not in skip:
            out += _odf_text(c, skip)
        out += c.tail or ""
    return out


def read_ods(raw: bytes) -> list[list[str]]:
    """The first sheet as it is shown, repeats expanded up to a limit, without
    empty ends, padded to one width."""
    body = child(Package(raw).xml("content.xml", need=True), "body", "spreadsheet", "table")
    if body is None:
        raise Unreadable("no sheet")
    out: list[list[str]] = []

    def rows(e: ElementTree.Element) -> None:
        for r in e:
            if local(r.tag) in ("table-rows", "table-header-rows", "table-row-group"):
                rows(r)
            if local(r.tag) != "table-row":
                continue
            line: list[str] = []
            for c in r:
                if local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                shown = "\n".join(_odf_text(x) for x in c if local(x.tag) == "p")
                text = shown or attr(c, "value") or attr(c, "date-value") or attr(c, "boolean-value") or attr(c, "string-value")
                n = int(attr(c, "number-columns-repeated", "1") or 1)
                line += [text] * (n if n <= MAX_REPEAT else 1)
            n = int(attr(r, "number-rows-repeated", "1") or 1)
            out.extend(list(line) for _ in range(n if n <= MAX_REPEAT else 1))
            if len(line) > MAX_COLUMNS or len(out) > MAX_ROWS:
                raise Unreadable("too large a sheet")

    rows(body)
    width = max((i + 1 for r in out for i, c in enumerate(r) if c), default=0)
    while out and not any(out[-1]):
        out.pop()
    return [(r + [""] * width)[:width] for r in out]


# ---- Word


def _on(e: ElementTree.Element | None) -> bool:
    return e is not None and attr(e, "val", "true").lower() not in ("0", "false", "none", "off")


def _lang_votes(votes: dict[str, int]) -> str:
    best = max(votes.values(), default=0)
    return "" if not best or votes.get("", 0) == best else min(k for k, v in votes.items() if v == best)


def tag(value: str) -> str:
    """A language tag in its usual case, '' where it is none."""
    t = value.strip().replace("_", "-")
    if not re.fullmatch(r"[A-Za-z]{2,3}(?:-[A-Za-z0-9]{1,8})*", t) or t.split("-")[0].lower() in ("und", "zxx", "mis", "mul"):
        return ""
    first, *rest = t.split("-")
    case = lambda p: p.upper() if len(p) == 2 and p.isalpha() else p.title() if len(p) == 4 and p.isalpha() else p.lower()
    return "-".join([first.lower(), *map(case, rest)])


def read_docx(raw: bytes) -> Document:
    """Headings by style or outline level, lists by numbering, links, styles and
    tables, whose first row is the header; the language is the document's own,
    else that of most letters, else the default."""
    p = Package(raw)
    rels = p.relations("word/document.xml")
    body = child(p.xml("word/document.xml", need=True), "body")
    styles: dict[str, ElementTree.Element] = {}
    default = ""
    sheet = p.xml("word/styles.xml")
    for s in sheet if sheet is not None else ():
        if local(s.tag) == "style":
            styles[attr(s, "styleId")] = s
        elif local(s.tag) == "docDefaults":
            default = attr(child(s, "rPrDefault", "rPr", "lang"), "val")
    numbers: dict[str, dict[int, tuple[bool, int]]] = {}
    lists = p.xml("word/numbering.xml")
    if lists is not None:
        kinds = {attr(a, "abstractNumId"): {int(attr(v, "ilvl", "0")): (attr(child(v, "numFmt"), "val") not in ("bullet", "none", ""), int(attr(child(v, "start"), "val", "1") or 1)) for v in a if local(v.tag) == "lvl"} for a in lists if local(a.tag) == "abstractNum"}
        numbers = {attr(n, "numId"): kinds.get(attr(child(n, "abstractNumId"), "val"), {}) for n in lists if local(n.tag) == "num"}

    def chain(style: str) -> list[ElementTree.Element]:
        out: list[ElementTree.Element] = []
        while style in styles and styles[style] not in out:
            out.append(styles[style])
            style = attr(child(styles[style], "basedOn"), "val")
        return out

    def level(props: ElementTree.Element | None) -> int:
        own = attr(child(props, "outlineLvl"), "val")
        for s in chain(attr(child(props, "pStyle"), "val")):
            m = re.match(r"heading\s*([1-9])", attr(child(s, "name"), "val"), re.I)
            if m:
                return min(6, int(m[1]))
            if attr(child(s, "name"), "val").lower() == "title":
                return 1
            own = own or attr(child(s, "pPr", "outlineLvl"), "val")
        return min(6, int(own) + 1) if own.isdigit() and int(own) < 9 else 0

    votes: dict[str, int] = {}
    counters: dict[tuple[str, int], int] = {}

    def spans(e: ElementTree.Element, href: str = "") -> list[Span]:
        out: list[Span] = []
        for c in e:
            name = local(c.tag)
            if name == "hyperlink":
                out += spans(c, rels.get(attr(c, "id"), "") or href)
            elif name in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out += spans(c, href)
            elif name == "r":
                props = child(c, "rPr")
                text = "".join((t.text or "") if local(t.tag) == "t" else {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(local(t.tag), "") for t in c)
                font = attr(child(props, "rFonts"), "ascii").lower()
                code = "courier" in font or "consolas" in font or "mono" in font or attr(child(props, "rStyle"), "val").lower() in ("code", "htmlcode", "verbatimchar")
                lang = attr(child(props, "lang"), "val")
                for s in chain(attr(child(props, "rStyle"), "val")) if not lang else ():
                    lang = lang or attr(child(s, "rPr", "lang"), "val")
                lang = tag(lang)
                votes[lang] = votes.get(lang, 0) + sum(map(str.isalpha, text))
                out.append(Span(text, _on(child(props, "b")), _on(child(props, "i")), code, _on(child(props, "strike")), href))
        return out

    def paragraph(e: ElementTree.Element) -> Block | None:
        props = child(e, "pPr")
        found = merged(spans(e))
        if not plain(found).strip():
            return Block(RULE) if child(props, "pBdr", "bottom") is not None else None
        h = level(props)
        if h:
            return Block(HEADING, [Span(s.text, False, s.italic, s.code, s.strike, s.href) for s in found], level=h)
        own = child(props, "numPr")
        for s in chain(attr(child(props, "pStyle"), "val")) if own is None else ():
            own = own if own is not None else child(s, "pPr", "numPr")
        number_id, depth = attr(child(own, "numId"), "val"), int(attr(child(own, "ilvl"), "val", "0") or 0)
        if own is not None and number_id not in ("", "0"):
            ordered, start = numbers.get(number_id, {}).get(depth, (False, 1))
            key = (number_id, depth)
            counters[key] = counters.get(key, start - 1) + 1
            for k in [k for k in counters if k[0] == number_id and k[1] > depth]:
                del counters[k]
            return Block(ITEM, found, level=depth + 1, ordered=ordered, number=counters[key] if ordered else 0)
        if all(s.code for s in found if s.text.strip()):
            return Block(CODE, text=plain(found))
        names = " ".join(attr(child(s, "name"), "val").lower() for s in chain(attr(child(props, "pStyle"), "val")))
        return Block(QUOTE if "quote" in names else PARAGRAPH, found)

    def cell(e: ElementTree.Element) -> list[Span]:
        out: list[Span] = []
        for x in e.iter():
            if local(x.tag) == "p":
                own = merged(spans(x))
                if plain(own).strip():
                    out += [Span("\n")] * bool(out) + own
        return merged(out)

    blocks: list[Block] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            name = local(c.tag)
            if name == "p":
                b = paragraph(c)
                if b and b.kind == CODE and blocks and blocks[-1].kind == CODE:
                    blocks[-1].text += "\n" + b.text
                elif b:
                    blocks.append(b)
            elif name == "tbl":
                rows = [[cell(x) for x in r if local(x.tag) == "tc"] for r in c if local(r.tag) == "tr"]
                rows = [r for r in rows if r]
                if rows and all(s.bold for x in rows[0] for s in x if s.text.strip()):
                    rows[0] = [[Span(s.text, False, s.italic, s.code, s.strike, s.href) for s in x] for x in rows[0]]
                blocks.extend([Block(TABLE, rows=rows, has_header=True)] if rows else [])
            elif name in ("sdt", "sdtContent"):
                walk(c)

    walk(body if body is not None else ())
    core = p.xml("docProps/core.xml")
    theme = attr(child(p.xml("word/settings.xml"), "themeFontLang"), "val")
    lang = tag(child(core, "language").text or "") if child(core, "language") is not None else ""
    title = (child(core, "title").text or "").strip() if child(core, "title") is not None else ""
    for unmarked in (tag(default),) if votes.get("") else ():
        votes[unmarked] = votes.get(unmarked, 0) + votes.pop("")
    return Document(blocks, title=title, lang=lang or _lang_votes(votes) or tag(theme))


def write_docx(d: Document) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    links: dict[str, str] = {}
    lists: list[bool] = []

    def run(s: Span) -> str:
        props = "".join(x for on, x in ((s.code, '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>'), (s.bold, "<w:b/>"), (s.italic, "<w:i/>"), (s.strike, "<w:strike/>"), (s.href, '<w:color w:val="0563C1"/><w:u w:val="single"/>')) if on)
        text = "<w:br/>".join(f'<w:t xml:space="preserve">{xml_text(t)}</w:t>' for t in s.text.split("\n"))
        out = f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{text}</w:r>"
        if s.href:
            rid = links.setdefault(s.href, f"rId{len(links) + 10}")
            return f'<w:hyperlink r:id="{rid}">{out}</w:hyperlink>'
        return out

    par = lambda spans, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(map(run, spans))}</w:p>"
    out: list[str] = []
    last: Block | None = None
    for b in d.blocks:
        if b.kind == HEADING:
            out.append(par(b.spans, f'<w:pStyle w:val="Heading{max(1, b.level)}"/>'))
        elif b.kind == CODE:
            out += [par([Span(x, code=True)], '<w:pStyle w:val="Code"/>') for x in b.text.split("\n")]
        elif b.kind == QUOTE:
            out.append(par(b.spans, '<w:pStyle w:val="Quote"/>'))
        elif b.kind == ITEM:
            if last is None or last.kind != ITEM or (b.level == 1 and last.ordered != b.ordered):
                lists.append(b.ordered)
            out.append(par(b.spans, f'<w:numPr><w:ilvl w:val="{max(0, b.level - 1)}"/><w:numId w:val="{len(lists)}"/></w:numPr>'))
        elif b.kind == TABLE:
            cell = lambda c, bold: f"<w:tc><w:tcPr/>{par([Span(s.text, bold or s.bold, s.italic, s.code, s.strike, s.href) for s in c])}</w:tc>"
            rows = "".join(f"<w:tr>{''.join(cell(c, b.has_header and i == 0) for c in r)}</w:tr>" for i, r in enumerate(b.rows))
            edge = "".join(f'<w:{x} w:val="single" w:sz="4"/>' for x in ("top", "left", "bottom", "right", "insideH", "insideV"))
            out.append(f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr>{rows}</w:tbl>" + par([]))
        elif b.kind == RULE:
            out.append(par([], '<w:pBdr><w:bottom w:val="single" w:sz="6"/></w:pBdr>'))
        else:
            out.append(par(b.spans))
        last = b
    style = lambda i, name, p, r="": f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/><w:pPr>{p}</w:pPr><w:rPr>{r}</w:rPr></w:style>'
    sizes = (32, 28, 24, 22, 22, 22)
    styles = "".join(style(f"Heading{i + 1}", f"heading {i + 1}", f'<w:outlineLvl w:val="{i}"/>', f'<w:b/><w:sz w:val="{s}"/>') for i, s in enumerate(sizes))
    styles += style("Quote", "Quote", '<w:ind w:left="720"/>', "<w:i/>") + style("Code", "Code", "", '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>')
    default = f'<w:docDefaults><w:rPrDefault><w:rPr>{f"<w:lang w:val={chr(34)}{xml_text(d.lang)}{chr(34)}/>" if d.lang else ""}</w:rPr></w:rPrDefault></w:docDefaults>'
    level = lambda n, k: f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{"decimal" if n else "bullet"}"/><w:lvlText w:val="{f"%{k + 1}." if n else "•"}"/><w:pPr><w:ind w:left="{720 * (k + 1)}" w:hanging="360"/></w:pPr></w:lvl>'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{i}">{"".join(level(n, k) for k in range(9))}</w:abstractNum>' for i, n in enumerate((False, True)))
    numbering += "".join(f'<w:num w:numId="{i + 1}"><w:abstractNumId w:val="{int(n)}"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="1"/></w:lvlOverride></w:num>' for i, n in enumerate(lists))
    core = f'{HEAD}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{xml_text(title_of(d))}</dc:title>{f"<dc:language>{xml_text(d.lang)}</dc:language>" if d.lang else ""}</cp:coreProperties>'
    over = "".join(f'<Override PartName="/word/{p}.xml" ContentType="{kind}{t}+xml"/>' for p, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering")))
    over += '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/>'
    rels = [("rId1", f"{OFFICE}/styles", "styles.xml"), ("rId2", f"{OFFICE}/numbering", "numbering.xml"), *((rid, f"{OFFICE}/hyperlink", href) for href, rid in links.items())]
    return zipped(
        [
            ("[Content_Types].xml", _types(over)),
            ("_rels/.rels", _rels([("rId1", f"{OFFICE}/officeDocument", "word/document.xml"), ("rId2", "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties", "docProps/core.xml")])),
            ("word/document.xml", f'{HEAD}<w:document xmlns:w="{w}" xmlns:r="{OFFICE}"><w:body>{"".join(out)}<w:sectPr/></w:body></w:document>'),
            ("word/_rels/document.xml.rels", _rels(rels)),
            ("word/styles.xml", f'{HEAD}<w:styles xmlns:w="{w}">{default}{styles}</w:styles>'),
            ("word/numbering.xml", f'{HEAD}<w:numbering xmlns:w="{w}">{numbering}</w:numbering>'),
            ("docProps/core.xml", core),
        ]
    )


# ---- OpenDocument text, slides, books, rich text


def read_odt(raw: bytes) -> Document:
    """Headings, lists (numbers at level 1), styles by name and tables; tracked
    changes and notes in the margin are left out."""
    p = Package(raw)
    content = p.xml("content.xml", need=True)
    flags: dict[str, tuple[bool, bool, bool, bool, str, str]] = {}
    ordered: set[str] = set()
    for part in (p.xml("styles.xml"), content):
        for s in part.iter() if part is not None else ():
            if local(s.tag) == "style":
                t = child(s, "text-properties")
                up = flags.get(attr(s, "parent-style-name"), (False, False, False, False, "", ""))
                lang = "-".join(x for x in (attr(t, "language"), attr(t, "country")) if x and x != "none")
                font = (attr(t, "font-name") + attr(t, "font-family")).lower()
                mono = up[2] or "courier" in font or "mono" in font or "consol" in font
                strike = attr(t, "text-line-through-style") not in ("", "none")
                flags[attr(s, "name")] = (attr(t, "font-weight", "bold" if up[0] else "") == "bold", attr(t, "font-style", "italic" if up[1] else "") == "italic", mono, strike or up[3], attr(s, "list-style-name"), lang or up[5])
            elif local(s.tag) == "list-style" and child(s, "list-level-style-number") is not None:
                ordered.add(attr(s, "name"))
    votes: dict[str, int] = {}
    none = (False, False, False, False, "", "")

    def spans(e: ElementTree.Element, style: tuple, href: str = "") -> list[Span]:
        out: list[Span] = []

        def say(t: str | None) -> None:
            if t:
                votes[tag(style[5])] = votes.get(tag(style[5]), 0) + sum(map(str.isalpha, t))
                out.append(Span(t, *style[:4], href))

        say(re.sub(r"\s+", " ", e.text) if e.text else None)
        for c in e:
            name = local(c.tag)
            if name == "span":
                own = flags.get(attr(c, "style-name"), none)
                out += spans(c, (*(a or b for a, b in zip(style[:4], own[:4], strict=True)), "", own[5] or style[5]), href)
            elif name == "a":
                out += spans(c, style, attr(c, "href"))
            elif name == "s":
                say(" " * int(attr(c, "c", "1") or 1))
            elif name in ("tab", "line-break"):
                say("\t" if name == "tab" else "\n")
            elif name not in ("annotation", "note", "tracked-changes"):
                out += spans(c, style, href)
            say(re.sub(r"\s+", " ", c.tail) if c.tail else None)
        return merged(out)

    blocks: list[Block] = []

    def walk(e: ElementTree.Element, depth: int = 0, number: list[int] | None = None, list_style: str = "") -> None:
        for c in e:
            name = local(c.tag)
            own = flags.get(attr(c, "style-name"), none)
            if name == "h":
                blocks.append(Block(HEADING, spans(c, (False, *own[1:])), level=min(6, int(attr(c, "outline-level", "1") or 1))))
            elif name == "p":
                found = spans(c, own)
                if plain(found).strip():
                    if depth:
                        numbered = list_style in ordered and depth == 1
                        if numbered and number is not None:
                            number[0] += 1
                        blocks.append(Block(ITEM, found, level=depth, ordered=numbered, number=number[0] if numbered and number else 0))
                    elif all(s.code for s in found if s.text.strip()):
                        blocks.append(Block(CODE, text=plain(found)))
                    else:
                        blocks.append(Block(QUOTE if "quot" in attr(c, "style-name").lower() else PARAGRAPH, found))
            elif name == "list":
                walk(c, depth + 1, number if depth else [0], attr(c, "style-name") or list_style)
            elif name == "table":
                rows = [[merged([s for i, x in enumerate(y for y in cell if local(y.tag) == "p") for s in ([Span("\n")] * bool(i) + spans(x, none))]) for cell in r if local(cell.tag) == "table-cell"] for r in c.iter() if local(r.tag) == "table-row"]
                blocks.extend([Block(TABLE, rows=rows, has_header=child(c, "table-header-rows") is not None)] if rows else [])
            elif name not in ("tracked-changes", "annotation", "forms", "sequence-decls"):
                walk(c, depth, number, list_style)

    body = child(content, "body", "text")
    walk(body if body is not None else ())
    meta = child(p.xml("meta.xml"), "meta")
    lang = tag((child(meta, "language").text or "") if child(meta, "language") is not None else "")
    title = (child(meta, "title").text or "").strip() if child(meta, "title") is not None else ""
    return Document(blocks, title=title, lang=lang or _lang_votes(votes))


def read_pptx(raw: bytes) -> Document:
    """Slides in the order of their numbers: the title as a heading, other
    paragraphs as list items by level, tables."""
    p = Package(raw)
    slides = sorted((int(m[1]), n) for n in p.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if not slides:
        raise Unreadable("no slides")
    blocks: list[Block] = []
    votes: dict[str, int] = {}

    def spans(par: ElementTree.Element) -> list[Span]:
        out = []
        for r in par:
            if local(r.tag) in ("r", "fld"):
                props, t = child(r, "rPr"), child(r, "t")
                text = (t.text or "") if t is not None else ""
                lang = tag(attr(props, "lang"))
                votes[lang] = votes.get(lang, 0) + sum(map(str.isalpha, text))
                out.append(Span(text, attr(props, "b") in ("1", "true"), attr(props, "i") in ("1", "true"), False, attr(props, "strike", "noStrike") not in ("", "noStrike")))
            elif local(r.tag) == "br":
                out.append(Span("\n"))
        return merged(out)

    for n, (_, name) in enumerate(slides, 1):
        titles: list[list[Span]] = []
        rest: list[Block] = []
        for shape in (x for x in p.xml(name).iter() if local(x.tag) in ("sp", "graphicFrame")):
            holder = next((x for x in shape.iter() if local(x.tag) == "ph"), None)
            if local(shape.tag) == "graphicFrame":
                rows = [[merged([s for i, par in enumerate(x for x in c.iter() if local(x.tag) == "p") for s in ([Span("\n")] * bool(i) + spans(par))]) for c in r if local(c.tag) == "tc"] for r in shape.iter() if local(r.tag) == "tr"]
                rest += [Block(TABLE, rows=rows, has_header=True)] if rows else []
                continue
            for par in (x for x in shape.iter() if local(x.tag) == "p"):
                found = spans(par)
                if plain(found).strip():
                    if attr(holder, "type") in ("title", "ctrTitle"):
                        titles.append(found)
                    else:
                        rest.append(Block(ITEM, found, level=int(attr(child(par, "pPr"), "lvl", "0") or 0) + 1))
        heads = titles or [[Span(f"Slide {n}")]]
        blocks += [Block(HEADING, h, level=2 if i == 0 else 3) for i, h in enumerate(heads)] + rest
    core = p.xml("docProps/core.xml")
    lang = tag((child(core, "language").text or "") if child(core, "language") is not None else "")
    title = (child(core, "title").text or "").strip() if child(core, "title") is not None else ""
    return Document(blocks, title=title, lang=lang or _lang_votes(votes))


def read_epub(raw: bytes) -> Document:
    """The chapters in the order of the spine, through the HTML reader."""
    p = Package(raw)
    root = next((attr(x, "full-path") for x in p.xml("META-INF/container.xml", need=True).iter() if local(x.tag) == "rootfile"), "")
    book = p.xml(root, need=True)
    items = {attr(i, "id"): attr(i, "href") for i in book.iter() if local(i.tag) == "item"}
    text = lambda n: next(((x.text or "").strip() for x in book.iter() if local(x.tag) == n), "")
    out = Document([], title=text("title"), lang=tag(text("language")))
    from urllib.parse import unquote

    for ref in (x for x in book.iter() if local(x.tag) == "itemref"):
        data = p.bytes(posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(items.get(attr(ref, "idref"), "")))))
        if data:
            d = read_html(data)
            out.blocks += d.blocks
            out.lang = out.lang or tag(d.lang)
    return out


def chapters(d: Document) -> list[Document]:
    """Cut at headings of level 1 where there are two or more."""
    at = [i for i, b in enumerate(d.blocks) if b.kind == HEADING and b.level == 1]
    if len(at) < 2:
        return [d]
    cuts = sorted({0, *at, len(d.blocks)})
    return [Document(d.blocks[a:b], lang=d.lang) for a, b in zip(cuts, cuts[1:], strict=False)]


def write_epub(d: Document) -> bytes:
    lang, title = d.lang or "und", xml_text(title_of(d))
    parts = chapters(d)
    xhtml = lambda c: re.sub(r"<(br|hr)>", r"<\1/>", body_html(c))
    page = lambda name, body: f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{lang}" lang="{lang}"><head><title>{name}</title></head><body>{body}</body></html>'
    names = [xml_text(title_of(c)) for c in parts]
    files = [f"chapter{i + 1}.xhtml" for i in range(len(parts))]
    ident = "urn:weft:" + re.sub(r"[^A-Za-z0-9]+", "-", title_of(d)).strip("-")[:60]
    manifest = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files))
    opf = (
        f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier>'
        f'<dc:title>{title}</dc:title><dc:language>{lang}</dc:language><meta property="dcterms:modified">{MODIFIED}</meta></metadata><manifest>'
        f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{manifest}</manifest>'
        f'<spine toc="ncx">{"".join(f"<itemref idref={chr(34)}c{i}{chr(34)}/>" for i in range(len(files)))}</spine></package>'
    )
    nav = page(title, '<nav epub:type="toc"><ol>' + "".join(f'<li><a href="{f}">{n}</a></li>' for f, n in zip(files, names, strict=True)) + "</ol></nav>")
    ncx = f'{HEAD}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{ident}"/></head><docTitle><text>{title}</text></docTitle><navMap>' + "".join(
        f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{n}</text></navLabel><content src="{f}"/></navPoint>' for i, (f, n) in enumerate(zip(files, names, strict=True))
    ) + "</navMap></ncx>"
    box = f'{HEAD}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    body = [(f"OEBPS/{f}", page(n, xhtml(c))) for f, n, c in zip(files, names, parts, strict=True)]
    return zipped([("mimetype", "application/epub+zip"), ("META-INF/container.xml", box), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", nav), ("OEBPS/toc.ncx", ncx), *body], stored="mimetype")


# Control words of rich text.
RTF_SKIPPED = set("fonttbl colortbl stylesheet info pict object header headerl headerr footer footerl footerr footnote themedata datastore listtable listoverridetable generator xmlnstbl rsidtbl latentstyles".split())
RTF_TEXT = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": "\xa0", "_": "-"}
RTF_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


# Windows language ids and their tags; other ids, as 1024, mark no language.
RTF_LANGUAGES = {
    1025: "ar-SA", 1026: "bg-BG", 1027: "ca-ES", 1028: "zh-TW", 1029: "cs-CZ", 1030: "da-DK", 1031: "de-DE", 1032: "el-GR", 1033: "en-US", 1034: "es-ES",
    1035: "fi-FI", 1036: "fr-FR", 1037: "he-IL", 1038: "hu-HU", 1040: "it-IT", 1041: "ja-JP", 1042: "ko-KR", 1043: "nl-NL", 1044: "nb-NO", 1045: "pl-PL",
    1046: "pt-BR", 1048: "ro-RO", 1049: "ru-RU", 1050: "hr-HR", 1051: "sk-SK", 1053: "sv-SE", 1054: "th-TH", 1055: "tr-TR", 1057: "id-ID", 1058: "uk-UA",
    1060: "sl-SI", 1061: "et-EE", 1062: "lv-LV", 1063: "lt-LT", 1065: "fa-IR", 1066: "vi-VN", 1068: "az-Latn-AZ", 1081: "hi-IN", 1086: "ms-MY", 1087: "kk-KZ",
    2052: "zh-CN", 2055: "de-CH", 2057: "en-GB", 2058: "es-MX", 2060: "fr-BE", 2067: "nl-BE", 2070: "pt-PT", 3076: "zh-HK", 3079: "de-AT", 3081: "en-AU",
    3082: "es-ES", 3084: "fr-CA", 4105: "en-CA", 4108: "fr-CH", 5129: "en-NZ", 6153: "en-IE", 11274: "es-AR",
}
EAST_ASIAN = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def read_rtf(raw: bytes) -> Document:
    """Paragraphs, styles and simple tables; groups that hold no text are skipped.

    The language is the one that marks most letters, East Asian letters being marked
    by their own words; two \\u of a surrogate pair are one character, and half of a
    pair alone is U+FFFD."""
    if not raw.lstrip()[:5].startswith(b"{\\rtf"):
        raise Unreadable("not rich text")
    page = "cp1252"
    state = {"b": False, "i": False, "strike": False, "skip": False, "uc": 1, "lang": 0, "langfe": 0}
    of_all, votes, high = {"lang": 0, "langfe": 0}, {}, 0
    stack: list[dict] = []
    spans: list[Span] = []
    row: list[list[Span]] = []
    rows: list[list[list[Span]]] = []
    blocks: list[Block] = []
    pending, in_table = 0, False

    def say(t: str) -> None:
        nonlocal high
        if high and t:
            t, high = "\ufffd" + t, 0
        if not state["skip"] and t:
            far = len(EAST_ASIAN.findall(t))
            for k, n in (("lang", sum(map(str.isalpha, t)) - far), ("langfe", far)):
                if n > 0:
                    name = RTF_LANGUAGES.get(state[k] or of_all[k], "")
                    votes[name] = votes.get(name, 0) + n
            spans.append(Span(t, state["b"], state["i"], False, state["strike"]))

    def end_table() -> None:
        if rows:
            blocks.append(Block(TABLE, rows=list(rows), has_header=False))
            rows.clear()

    def end_paragraph() -> None:
        nonlocal in_table
        found = merged(spans)
        spans.clear()
        if plain(found).strip():
            end_table()
            blocks.append(Block(PARAGRAPH, found))

    for m in RTF_TOKEN.finditer(raw):
        word, number, code, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append(dict(state))
        elif brace:
            state = stack.pop() if stack else state
        elif word:
            k, n = word.decode(), int(number) if number else None
            if k in RTF_SKIPPED:
                state["skip"] = True
            elif k == "ansicpg" and n:
                page = f"cp{n}"
            elif k in ("b", "i", "strike"):
                state[k] = n != 0
            elif k == "plain":
                state |= {"b": False, "i": False, "strike": False, "lang": 0, "langfe": 0}
            elif k in ("lang", "langfe"):
                state[k] = n or 0
            elif k in ("deflang", "deflangfe"):
                of_all[k.removeprefix("def")] = n or 0
            elif k == "uc":
                state["uc"] = n or 0
            elif k == "u" and n is not None:
                point, pending = n % 65536, state["uc"]
                if high and 0xDC00 <= point < 0xE000:
                    point, high = 0x10000 + ((high - 0xD800) << 10) + point - 0xDC00, 0
                if 0xD800 <= point < 0xDC00:
                    if high:
                        high = 0
                        say("\ufffd")
                    high = point
                else:
                    say("\ufffd" if 0xDC00 <= point < 0xE000 else chr(point))
            elif k == "intbl":
                in_table = True
            elif k == "pard":
                in_table = False
            elif k == "cell" and not state["skip"]:
                row.append(merged(spans))
                spans.clear()
            elif k == "row" and not state["skip"]:
                rows += [list(row)] if row else []
                row.clear()
            elif k == "par" and not state["skip"]:
                say("\n") if in_table else end_paragraph()
            elif k in RTF_TEXT:
                say(RTF_TEXT[k])
        elif code:
            if pending:
                pending -= 1
                continue
            try:
                say(bytes([int(code, 16)]).decode(page, "replace"))
            except LookupError:
                say(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign:
            if sign == b"*":
                state["skip"] = True
            elif sign in (b"\\", b"{", b"}"):
                say(sign.decode())
            else:
                say(RTF_TEXT.get(sign.decode("latin-1"), ""))
        elif text:
            t = text.decode("cp1252", "replace")
            say(t[pending:])
            pending = max(0, pending - len(t))
    if high:
        high = 0
        say("\ufffd")
    end_paragraph()
    end_table()
    return Document(blocks, lang=_lang_votes(votes))
