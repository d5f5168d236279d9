"""Documents as lists of blocks, with readers and writers for text, Markdown and HTML."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field, replace

from .trees import text_of

PARAGRAPH, HEADING, CODE, QUOTE, ITEM, TABLE, RULE = "paragraph", "heading", "code", "quote", "item", "table", "rule"


@dataclass
class Span:
    text: str
    bold: bool = False
    italic: bool = False
    code: bool = False
    strike: bool = False
    href: str = ""

    def style(self) -> tuple:
        return self.bold, self.italic, self.code, self.strike, self.href


@dataclass
class Block:
    kind: str
    spans: list[Span] = field(default_factory=list)
    level: int = 0
    ordered: bool = False
    number: int = 0
    text: str = ""
    info: str = ""
    rows: list[list[list[Span]]] = field(default_factory=list)
    has_header: bool = False


@dataclass
class Document:
    blocks: list[Block]
    title: str = ""
    lang: str = ""


def plain(spans: list[Span]) -> str:
    return "".join(s.text for s in spans)


def merged(spans: list[Span]) -> list[Span]:
    """Neighbours of one style joined, empty ones left out."""
    out: list[Span] = []
    for s in spans:
        if s.text and out and out[-1].style() == s.style():
            out[-1] = replace(out[-1], text=out[-1].text + s.text)
        elif s.text:
            out.append(s)
    return out


def collapsed(spans: list[Span]) -> list[Span]:
    """White space made single spaces over style boundaries; line breaks stay."""
    out, after_space = [], True
    for s in merged(spans):
        t = re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f\v]+", " ", s.text))
        if after_space:
            t = t.lstrip(" ")
        if t:
            out.append(replace(s, text=t))
            after_space = t[-1] in " \n"
    while out and not out[-1].text.strip():
        out.pop()
    if out:
        out[-1] = replace(out[-1], text=out[-1].text.rstrip())
    return out


def title_of(d: Document) -> str:
    """The given title, else the first heading, else the first paragraph."""
    if d.title:
        return d.title
    for kind in (HEADING, PARAGRAPH):
        for b in d.blocks:
            if b.kind == kind and plain(b.spans).strip():
                return " ".join(plain(b.spans).split())[:80]
    return "Document"


# ---- plain text


def read_text(raw: bytes) -> Document:
    text = text_of(raw).replace("\r\n", "\n")
    parts = [p.strip("\n") for p in re.split(r"\n[ \t]*\n", text)]
    return Document([Block(PARAGRAPH, [Span(p)]) for p in parts if p.strip()])


def write_text(d: Document) -> bytes:
    out: list[str] = []
    last_item = False
    for b in d.blocks:
        t = plain(b.spans)
        if b.kind == HEADING:
            piece = f"{t}\n{('=' if b.level == 1 else '-') * max(1, len(t))}"
        elif b.kind == CODE:
            piece = "\n".join("    " + x for x in b.text.rstrip("\n").split("\n"))
        elif b.kind == QUOTE:
            piece = "\n".join("> " + x for x in t.split("\n"))
        elif b.kind == ITEM:
            piece = "  " * max(0, b.level - 1) + (f"{b.number}. " if b.ordered else "- ") + t
        elif b.kind == TABLE:
            piece = "\n".join("\t".join(plain(c).replace("\n", " ") for c in r) for r in b.rows)
        else:
            piece = "-" * 10 if b.kind == RULE else t
        if out:
            out.append("\n" if last_item and b.kind == ITEM else "\n\n")
        out.append(piece)
        last_item = b.kind == ITEM
    return ("".join(out) + "\n" * bool(out)).encode()


# ---- HTML

SKIPPED = r"script|style|noscript|template|svg|head"
HTML_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({SKIPPED})(?:[\s/][^>]*)?>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
HTML_STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code", "kbd": "code", "samp": "code", "tt": "code", "s": "strike", "del": "strike", "strike": "strike", "a": "href"}
HTML_BREAKS = set("p div section article header footer main nav aside figure figcaption form fieldset address dl dt dd body html table tr thead tbody tfoot caption center details summary".split())
HTML_LANG = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([^\"'\s>]+)", re.I)


def attribute(attributes: str, name: str) -> str:
    m = re.search(rf"(?:\A|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", attributes, re.I)
    return entities.unescape(next((g for g in m.groups() if g is not None), "")) if m else ""


def read_html(raw: bytes) -> Document:
    """Blocks from the tags as they come, without a tree.

    An inline style that isn't closed stays on; any closing inline tag ends the
    latest style.  Inside a table cell block tags are breaks, and a paragraph in a
    list item belongs to the item."""
    source = text_of(raw)
    m = HTML_LANG.search(source)
    d = Document([], lang=m[1] if m else "")
    styles: list[tuple[str, str]] = []
    spans: list[Span] = []
    lists: list[list] = []  # [ordered, next number]
    table: Block | None = None
    header_cell = in_cell = in_item = False
    quote = 0
    heading = 0
    item_open: tuple[bool, int, int] | None = None

    def flush() -> None:
        nonlocal item_open
        found = collapsed(spans)
        spans.clear()
        if not found:
            return
        if heading:
            d.blocks.append(Block(HEADING, found, level=heading))
        elif item_open is not None:
            d.blocks.append(Block(ITEM, found, level=item_open[2], ordered=item_open[0], number=item_open[1]))
            item_open = None
        elif quote:
            d.blocks.append(Block(QUOTE, found))
        else:
            d.blocks.append(Block(PARAGRAPH, found))

    def end_cell() -> None:
        nonlocal in_cell
        if table is not None and in_cell:
            if not table.rows:
                table.rows.append([])
            table.rows[-1].append(collapsed(spans))
            spans.clear()
            in_cell = False

    def say(text: str) -> None:
        if text:
            style: dict = {}
            for kind, value in styles:
                style[kind] = value if kind == "href" else True
            spans.append(Span(entities.unescape(text).replace("\xa0", " "), **style))

    at, pre = 0, False
    for m in HTML_TOKEN.finditer(source):
        piece = source[at : m.start()]
        at = m.end()
        if piece and pre:
            d.blocks[-1].text += entities.unescape(piece)
        elif piece:
            say(re.sub(r"\s+", " ", piece))
        if m[3] is None:
            continue
        close, tag, attrs = bool(m[2]), m[3].lower(), m[4]
        if pre and not (tag == "pre" and close):
            if tag == "br":
                d.blocks[-1].text += "\n"
            continue
        if tag in HTML_STYLES:
            if close:
                styles[-1:] = []
            else:
                styles.append((HTML_STYLES[tag], attribute(attrs, "href") if tag == "a" else ""))
        elif tag == "br":
            say("\n")
        elif tag == "img" and not close:
            label = attribute(attrs, "alt") or attribute(attrs, "src")
            say(f"[{entities.escape(label)}]" if label else "")
        elif tag in ("td", "th") and table is not None:
            end_cell()
            if not close:
                in_cell, header_cell = True, header_cell or (tag == "th" and len(table.rows) <= 1)
                table.has_header |= header_cell and len(table.rows) <= 1
        elif tag == "tr" and table is not None:
            end_cell()
            if not close:
                table.rows.append([])
        elif tag == "table":
            if close and table is not None:
                end_cell()
                table.rows = [r for r in table.rows if r]
                if table.rows:
                    d.blocks.append(table)
                table = None
            elif not close and table is None:
                flush()
                table, header_cell = Block(TABLE), False
        elif in_cell:
            if tag in HTML_BREAKS or tag in ("li", "ul", "ol", "pre", "blockquote", "hr") or re.fullmatch("h[1-6]", tag):
                if plain(spans).strip():
                    say("\n")
        elif tag == "pre":
            flush()
            if not close:
                d.blocks.append(Block(CODE))
            elif pre:
                d.blocks[-1].text = d.blocks[-1].text.strip("\n")
            pre = not close
        elif tag == "hr":
            flush()
            d.blocks.append(Block(RULE))
        elif re.fullmatch("h[1-6]", tag):
            flush()
            heading = 0 if close else int(tag[1])
        elif tag == "blockquote":
            flush()
            quote = max(0, quote + (-1 if close else 1))
        elif tag in ("ul", "ol"):
            flush()
            if close:
                lists[-1:] = []
            else:
                start = attribute(attrs, "start")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            item_open = None
        elif tag == "li":
            flush()
            item_open = None
            if not close:
                own = lists[-1] if lists else [False, 1]
                item_open = (own[0], own[1] if own[0] else 0, max(1, len(lists)))
                own[1] += 1
        elif tag in HTML_BREAKS:
            flush()
    rest = source[at:]
    if pre:
        d.blocks[-1].text += entities.unescape(rest)
    else:
        say(re.sub(r"\s+", " ", re.sub(r"<[^>]*\Z", "", rest)))
    end_cell()
    if table is not None and table.rows:
        d.blocks.append(table)
    flush()
    return d


def spans_html(spans: list[Span]) -> str:
    out = []
    for s in spans:
        t = entities.escape(s.text, quote=False).replace("\n", "<br>\n")
        for on, tag in ((s.code, "code"), (s.strike, "del"), (s.italic, "em"), (s.bold, "strong")):
            t = f"<{tag}>{t}</{tag}>" if on else t
        out.append(f'<a href="{entities.escape(s.href)}">{t}</a>' if s.href else t)
    return "".join(out)


def body_html(d: Document) -> str:
    out: list[str] = []
    opened: list[str] = []
    for b in d.blocks:
        depth = max(1, b.level) if b.kind == ITEM else 0
        while len(opened) > depth:
            out.append(f"</li>\n</{opened.pop()}>\n")
        if b.kind == ITEM:
            tag = "ol" if b.ordered else "ul"
            if len(opened) == depth:
                if opened[-1] != tag:
                    out.append(f"</li>\n</{opened.pop()}>\n")
                else:
                    out.append("</li>\n")
            while len(opened) < depth:
                start = f' start="{b.number}"' if b.ordered and b.number > 1 and len(opened) == depth - 1 else ""
                out.append(f"<{tag}{start}>\n" + ("<li>" if len(opened) < depth - 1 else ""))
                opened.append(tag)
            out.append(f"<li>{spans_html(b.spans)}")
        elif b.kind == HEADING:
            out.append(f"<h{b.level}>{spans_html(b.spans)}</h{b.level}>\n")
        elif b.kind == CODE:
            kind = f' class="language-{entities.escape(b.info)}"' if b.info else ""
            out.append(f"<pre><code{kind}>{entities.escape(b.text, quote=False)}</code></pre>\n")
        elif b.kind == QUOTE:
            out.append(f"<blockquote><p>{spans_html(b.spans)}</p></blockquote>\n")
        elif b.kind == TABLE:
            line = lambda r, t: "<tr>" + "".join(f"<{t}>{spans_html(c)}</{t}>" for c in r) + "</tr>\n"
            out.append("<table>\n" + "".join(line(r, "th" if b.has_header and i == 0 else "td") for i, r in enumerate(b.rows)) + "</table>\n")
        else:
            out.append("<hr>\n" if b.kind == RULE else f"<p>{spans_html(b.spans)}</p>\n")
    while opened:
        out.append(f"</li>\n</{opened.pop()}>\n")
    return "".join(out)


def write_html(d: Document) -> bytes:
    from weftline.functions.text import PAGE

    lang = f' lang="{entities.escape(d.lang)}"' if d.lang else ""
    return PAGE.format(lang=lang, title=entities.escape(title_of(d), quote=False), body=body_html(d)).encode()


# ---- Markdown

FENCE, ITEM_LINE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`\n]*)"), re.compile(r"( *)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|)\Z", re.S)
INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<tick>`+)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)[^)]*\)|\[(?P<text>(?:[^\[\]\\]|\\.)*)\]\((?P<href><[^>]*>|[^)\s]*)(?:\s+[^)]*)?\)"
    r"|<(?P<auto>[a-z][a-z0-9+.-]*:[^ >]*|[^ >@]+@[^ >]+)>|(?P<mark>\*{1,3}|_{1,3}|~~)|(?P<tag></?[A-Za-z][^>]*>)|(?P<br> {2,}\n|\\\n)|(?P<url>https?://[^\s<]*[^\s<.,;:!?)'\"])|(?P<nl>\n)",
)


def front_matter(text: str) -> tuple[dict, str]:
    """A mapping between --- lines at the start, and the rest."""
    text = text.replace("\r\n", "\n")
    m = re.match(r"---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", text, re.S)
    if m:
        from . import Unreadable
        from .trees import read_yaml

        try:
            found = read_yaml(m[1].encode())
        except (Unreadable, ImportError):
            found = None
        if isinstance(found, dict) and found:
            return found, text[m.end() :]
    return {}, text


def inline(text: str, base: Span | None = None) -> list[Span]:
    """Spans of a line of Markdown; marks that open nothing or close nothing stay."""
    base = base or Span("")
    out: list[Span] = []
    open_marks: list[tuple[str, int]] = []
    at = 0

    def add(t: str, **style) -> None:
        if t:
            out.append(replace(base, text=t, **style))

    while at < len(text):
        m = INLINE.search(text, at)
        if not m:
            break
        add(text[at : m.start()])
        at = m.end()
        if m["esc"]:
            add(m["esc"][1])
        elif m["tick"]:
            end = re.compile(rf"(?<!`){m['tick']}(?!`)").search(text, at)
            if end:
                add(re.sub(r"\A | \Z", "", text[at : end.start()].replace("\n", " ")) or " ", code=True)
                at = end.end()
            else:
                add(m["tick"])
        elif m["src"] is not None:
            add(f"[{m['alt'] or m['src']}]")
        elif m["href"] is not None:
            out += inline(m["text"], replace(base, href=entities.unescape(m["href"].strip("<>"))))
        elif m["auto"] or m["url"]:
            u = m["auto"] or m["url"]
            add(u, href=u if ":" in u else f"mailto:{u}")
        elif m["mark"]:
            k = m["mark"]
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            word = k[0] == "_" and before.isalnum() and after.isalnum()
            same = next((i for i in range(len(open_marks) - 1, -1, -1) if open_marks[i][0] == k), None)
            if same is not None and not before.isspace() and not (k[0] == "_" and after.isalnum()):
                start = open_marks[same][1]
                style = {"~~": {"strike": True}}.get(k) or {1: {"italic": True}, 2: {"bold": True}, 3: {"bold": True, "italic": True}}[len(k)]
                out[start:] = [replace(s, **style) for s in out[start + 1 :]]
                del open_marks[same:]
            elif not after.isspace() and not word:
                open_marks.append((k, len(out)))
                out.append(replace(base, text=k))
            else:
                add(k)
        elif m["br"]:
            add("\n")
        elif m["nl"]:
            add(" ")
    add(text[at:])
    return merged([replace(s, text=s.text if s.code else entities.unescape(s.text)) for s in out])


def _row(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|\s*\Z", "", re.sub(r"\A\s*\|", "", line)))]


def read_markdown(raw: bytes) -> Document:
    """Headings, paragraphs, lists, quotes, fenced and indented code, tables,
    rules and inline marks; a raw HTML block becomes its text."""
    meta, text = front_matter(text_of(raw))
    lang = next((str(meta[k]) for k in ("lang", "language") if isinstance(meta.get(k), str)), "")
    d = Document([], title=meta["title"] if isinstance(meta.get("title"), str) else "", lang=lang)
    lines = text.expandtabs(4).split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            end = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}\s*\Z")
            j = next((j for j in range(i + 1, len(lines)) if end.match(lines[j])), len(lines))
            d.blocks.append(Block(CODE, text="\n".join(lines[i + 1 : j]), info=(m[3].split() or [""])[0]))
            i = j + 1
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z", line):
            d.blocks.append(Block(HEADING, inline((m[2] or "").strip()), level=len(m[1])))
            i += 1
        elif re.match(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z", line):
            d.blocks.append(Block(RULE))
            i += 1
        elif line.startswith("    "):
            j = i
            while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            d.blocks.append(Block(CODE, text="\n".join(x[4:] for x in lines[i:j]).rstrip("\n")))
            i = j
        elif re.match(r" {0,3}>", line):
            j = i
            while j < len(lines) and lines[j].strip() and (re.match(r" {0,3}>", lines[j]) or j > i):
                j += 1
            inner = read_markdown("\n".join(re.sub(r"\A {0,3}> ?", "", x) for x in lines[i:j]).encode())
            d.blocks += [replace(b, kind=QUOTE) if b.kind == PARAGRAPH else b for b in inner.blocks]
            i = j
        elif ITEM_LINE.match(line):
            i = _list(lines, i, d)
        elif i + 1 < len(lines) and "|" in line and re.match(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*\Z", lines[i + 1]) and len(_row(line)) == len(_row(lines[i + 1])):
            j = i + 2
            while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                j += 1
            width = len(_row(line))
            rows = [[inline(c) for c in (_row(x) + [""] * width)[:width]] for x in (line, *lines[i + 2 : j])]
            header = any(plain(c) for c in rows[0])
            d.blocks.append(Block(TABLE, rows=rows if header else rows[1:], has_header=header))
            i = j
        elif re.match(r" {0,3}<(?:[A-Za-z!/?])", line) and not re.match(r" {0,3}<[a-z][a-z0-9+.-]*:", line):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            t = " ".join(entities.unescape(re.sub(r"<!--.*?-->|<[^>]*>", "", "\n".join(lines[i:j]), flags=re.S)).split())
            d.blocks += [Block(PARAGRAPH, [Span(t)])] if t else []
            i = j
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not re.match(r" {0,3}(?:#{1,6}(?: |\Z)|>|`{3}|~{3}|(?:[-*+]|1[.)]) +\S|(?:=+|-+)\s*\Z)", lines[j]):
                j += 1
            body = "\n".join(x.lstrip() for x in lines[i:j]).rstrip()
            under = re.match(r" {0,3}(=+|-+)\s*\Z", lines[j]) if j < len(lines) else None
            d.blocks.append(Block(HEADING, inline(body), level=1 if under[1][0] == "=" else 2) if under else Block(PARAGRAPH, inline(body)))
            i = j + bool(under)
    return d


def _list(lines: list[str], i: int, d: Document) -> int:
    """Items of nested lists; deeper indents are deeper levels."""
    indents: list[list] = []  # [indent of the text, ordered, next number]
    while i < len(lines):
        if not lines[i].strip():
            k = i + 1
            while k < len(lines) and not lines[k].strip():
                k += 1
            if k >= len(lines) or not (ITEM_LINE.match(lines[k]) or indents and len(lines[k]) - len(lines[k].lstrip()) >= indents[0][0]):
                return k
            i = k
            continue
        m = ITEM_LINE.match(lines[i])
        lead = len(lines[i]) - len(lines[i].lstrip())
        if not m:
            if d.blocks and d.blocks[-1].kind == ITEM and (lead >= (indents[-1][0] if indents else 2) or lines[i - 1].strip()):
                if not lines[i - 1].strip():
                    d.blocks.append(Block(PARAGRAPH, inline(lines[i].strip())))
                else:
                    d.blocks[-1].spans = merged([*d.blocks[-1].spans, Span(" "), *inline(lines[i].strip())])
                i += 1
                continue
            return i
        while indents and lead < indents[-1][0] - (len(indents) == 1 and lead == 0) and lead < indents[-1][0]:
            if len(indents) > 1 and lead >= indents[-2][0] and lead < indents[-1][0] or len(indents) == 1:
                break
            indents.pop()
        ordered = m[2][0].isdigit()
        if not indents or lead >= indents[-1][0]:
            indents.append([lead + len(m[2]) + 1, ordered, int(m[2][:-1]) if ordered else 1])
        elif indents[-1][1] != ordered:
            indents[-1][1:] = [ordered, int(m[2][:-1]) if ordered else 1]
        text = re.sub(r"\A\[([ xX])\] ", lambda c: "[x] " if c[1] in "xX" else "[ ] ", m[3] or "")
        d.blocks.append(Block(ITEM, inline(text), level=len(indents), ordered=ordered, number=indents[-1][2] if ordered else 0))
        indents[-1][2] += 1
        i += 1
    return i


def spans_markdown(spans: list[Span], cell: bool = False) -> str:
    out = []
    for s in spans:
        if s.code:
            tick = "`" * (max(map(len, re.findall("`+", s.text)), default=0) + 1)
            t = f"{tick} {s.text} {tick}" if "`" in s.text else f"{tick}{s.text}{tick}"
        else:
            t = re.sub(r"([\\*_`\[\]<|])", r"\\\1", s.text)
            t = t.replace("\n", "<br>" if cell else "  \n")
        core = t.strip()
        if core:
            lead, tail = t[: len(t) - len(t.lstrip())], t[len(t.rstrip()) :]
            for on, mark in ((s.strike, "~~"), (s.italic, "*"), (s.bold, "**")):
                core = f"{mark}{core}{mark}" if on else core
            t = lead + core + tail
        out.append(f"[{t}]({s.href})" if s.href else t)
    return "".join(out)


def table_markdown(rows: list[list[list[Span]]], has_header: bool) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    full = [[*r, *([[]] * (width - len(r)))] for r in rows]
    head, body = (full[0], full[1:]) if has_header else ([[]] * width, full)
    line = lambda r: "| " + " | ".join(spans_markdown(c, True) for c in r) + " |"
    return "\n".join([line(head), "|" + "|".join([" --- "] * width) + "|", *map(line, body)])


def write_markdown(d: Document) -> bytes:
    out: list[str] = []
    last_item = False
    for b in d.blocks:
        t = spans_markdown(b.spans)
        if b.kind == HEADING:
            piece = "#" * min(6, max(1, b.level)) + " " + t.replace("  \n", " ")
        elif b.kind == CODE:
            fence = "`" * max(3, max(map(len, re.findall("`+", b.text)), default=0) + 1)
            piece = f"{fence}{b.info}\n{b.text}\n{fence}"
        elif b.kind == QUOTE:
            piece = "\n".join("> " + x for x in t.split("\n"))
        elif b.kind == ITEM:
            piece = "   " * max(0, b.level - 1) + (f"{b.number}. " if b.ordered else "- ") + t
        elif b.kind == TABLE:
            piece = table_markdown(b.rows, b.has_header)
        else:
            piece = "---" if b.kind == RULE else re.sub(r"\A([#>+-]|\d+[.)])", r"\\\1", t)
        if out:
            out.append("\n" if last_item and b.kind == ITEM else "\n\n")
        out.append(piece)
        last_item = b.kind == ITEM
    return ("".join(out) + "\n" * bool(out)).encode()


def from_rows(rows: list[list[str]]) -> Document:
    return Document([Block(TABLE, rows=[[[Span(c)] for c in r] for r in rows], has_header=True)] if rows else [])


def to_rows(d: Document) -> list[list[str]]:
    """The first table's cells as text."""
    return next(([[plain(c) for c in r] for r in b.rows] for b in d.blocks if b.kind == TABLE), [])
