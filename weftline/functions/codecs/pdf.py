"""PDF pages from documents and pictures.

Text is set in the standard Latin fonts, whose files no reader needs; characters
outside their set are shown as a question mark.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import Unreadable
from .blocks import CODE, HEADING, ITEM, QUOTE, RULE, TABLE, Document, Span, plain, title_of

# A4 in points, margin, longest side of a picture's page, and widths
# of the standard proportional font in thousandths, for characters 32 to 126.
WIDTH, HEIGHT, MARGIN, LONG_SIDE = 595.28, 841.89, 56.7, 841.89
ADVANCES = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 "
    "667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 "
    "556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
FONTS = {"F1": "Helvetica", "F2": "Helvetica-Bold", "F3": "Helvetica-Oblique", "F4": "Helvetica-BoldOblique", "F5": "Courier"}


def _encoded(text: str) -> bytes:
    return text.encode("cp1252", "replace")


def width(text: str, size: float, font: str) -> float:
    if font == "F5":
        return 0.6 * size * len(text)
    table = list(map(int, ADVANCES.split()))
    bold = 1.06 if font in ("F2", "F4") else 1.0
    return sum(table[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in text) * size / 1000 * bold


def literal(raw: bytes) -> bytes:
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        raw = raw.replace(a, b)
    return b"(" + raw + b")"


def assemble(objects: list[bytes]) -> bytes:
    """The file of numbered objects, the first of which is the catalogue."""
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info 2 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def stream(data: bytes, extra: str = "", packed: bool = True) -> bytes:
    body = zlib.compress(data, 9) if packed else data
    head = f"<< /Length {len(body)}{' /Filter /FlateDecode' if packed else ''}{extra} >>\nstream\n".encode()
    return head + body + b"\nendstream"


class Pages:
    """Lines set from the top of a page down."""

    def __init__(self) -> None:
        self.pages: list[list[bytes]] = [[]]
        self.links: list[list[tuple[float, float, float, float, str]]] = [[]]
        self.y = HEIGHT - MARGIN

    def room(self, need: float) -> None:
        if self.y - need < MARGIN and self.pages[-1]:
            self.pages.append([])
            self.links.append([])
            self.y = HEIGHT - MARGIN

    def words(self, spans: list[Span], size: float, bold: bool) -> list[tuple[str, str, str]]:
        out = []
        for s in spans:
            font = "F5" if s.code else "F4" if (s.bold or bold) and s.italic else "F2" if s.bold or bold else "F3" if s.italic else "F1"
            for i, line in enumerate(s.text.split("\n")):
                if i:
                    out.append(("\n", font, ""))
                words = line.split(" ")
                out += [(w + (" " if k < len(words) - 1 else ""), font, s.href) for k, w in enumerate(words) if w or k < len(words) - 1]
        return out

    def paragraph(self, spans: list[Span], size: float = 11, left: float = 0, bold: bool = False, mark: str = "", gap: float = 6, right: float | None = None) -> None:
        room = (right if right is not None else WIDTH - 2 * MARGIN) - left
        lines: list[list[tuple[str, str, str]]] = [[]]
        used = 0.0
        for word, font, href in self.words(spans, size, bold):
            if word == "\n":
                lines.append([])
                used = 0.0
                continue
            while (w := width(word.rstrip(" "), size, font)) > room and len(word) > 1:  # longer than a line
                k = max(1, int(len(word) * room / w))
                lines.append([(word[:k], font, href)])
                word, used = word[k:], room
            if lines[-1] and used + w > room:
                lines.append([])
                used = 0.0
            lines[-1].append((word, font, href))
            used += width(word, size, font)
        for i, line in enumerate(lines):
            self.room(size * 1.35)
            self.y -= size * 1.35
            x = MARGIN + left
            if mark and i == 0:
                self.put(mark, "F1", size, x - width(mark + " ", size, "F1"))
            for word, font, href in line:
                self.put(word, font, size, x)
                w = width(word, size, font)
                if href:
                    self.links[-1].append((x, self.y - 2, x + w, self.y + size, href))
                x += w
        self.y -= gap

    def put(self, text: str, font: str, size: float, x: float) -> None:
        self.pages[-1].append(b"BT /%b %.2f Tf %.2f %.2f Td %b Tj ET" % (font.encode(), size, x, self.y, literal(_encoded(text))))

    def rule(self) -> None:
        self.room(14)
        self.y -= 7
        self.pages[-1].append(b"0.6 w %.2f %.2f m %.2f %.2f l S" % (MARGIN, self.y, WIDTH - MARGIN, self.y))
        self.y -= 7

    def table(self, rows: list[list[list[Span]]], header: bool) -> None:
        n = max(map(len, rows), default=0)
        if not n:
            return
        full = WIDTH - 2 * MARGIN
        want = [min(full / 2, max(30, *(width(plain(r[i]), 10, "F1") + 8 for r in rows if i < len(r)))) for i in range(n)]
        scale = full / sum(want) if sum(want) > full else 1
        lefts = [sum(want[:i]) * scale for i in range(n + 1)]
        for k, r in enumerate(rows):
            self.room(20)
            top, low, page = self.y, self.y, len(self.pages)
            for i, c in enumerate(r):
                if len(self.pages) == page:
                    self.y = top
                self.paragraph(c, 10, lefts[i] + 3, bold=header and k == 0, gap=3, right=lefts[i + 1] - 3)
                low = min(low, self.y) if len(self.pages) == page else self.y
            self.y = low
            self.pages[-1].append(b"0.3 w %.2f %.2f m %.2f %.2f l S" % (MARGIN, self.y, MARGIN + lefts[n], self.y))
        self.y -= 6


def write_document(d: Document) -> bytes:
    p = Pages()
    for b in d.blocks:
        if b.kind == HEADING:
            size = {1: 20, 2: 16, 3: 13}.get(b.level, 11.5)
            p.room(size * 3)
            p.paragraph(b.spans, size, bold=True, gap=8)
        elif b.kind == CODE:
            for line in b.text.split("\n"):
                p.paragraph([Span(line or " ", code=True)], 9.5, 8, gap=0)
            p.y -= 6
        elif b.kind == QUOTE:
            p.paragraph([Span(s.text, s.bold, True, s.code, s.strike, s.href) for s in b.spans], left=18)
        elif b.kind == ITEM:
            p.paragraph(b.spans, left=18 * max(1, b.level), mark=f"{b.number}." if b.ordered else "•", gap=2)
        elif b.kind == TABLE:
            p.table(b.rows, b.has_header)
        elif b.kind == RULE:
            p.rule()
        else:
            p.paragraph(b.spans)
    fonts = {k: 4 + i for i, k in enumerate(FONTS)}
    objects = [b"", b"", b""]
    objects += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{n} /Encoding /WinAnsiEncoding >>".encode() for n in FONTS.values()]
    kids = []
    use = " ".join(f"/{k} {i} 0 R" for k, i in fonts.items())
    for ops, links in zip(p.pages, p.links, strict=True):
        objects.append(stream(b"\n".join(ops)))
        content, notes = len(objects), []
        for x0, y0, x1, y1, href in links:
            objects.append(b"<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect [%.2f %.2f %.2f %.2f] /A << /S /URI /URI %b >> >>" % (x0, y0, x1, y1, literal(href.encode("ascii", "replace"))))
            notes.append(f"{len(objects)} 0 R")
        objects.append(
            f"<< /Type /Page /Parent 3 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << {use} >> >> /Contents {content} 0 R /Annots [{' '.join(notes)}] >>".encode()
        )
        kids.append(len(objects))
    lang = b" /Lang " + literal(d.lang.encode("ascii", "replace")) if d.lang else b""
    objects[0] = b"<< /Type /Catalog /Pages 3 0 R" + lang + b" >>"
    objects[1] = b"<< /Title (\xfe\xff" + literal(title_of(d).encode("utf-16-be"))[1:-1] + b") >>"
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    return assemble(objects)


def jpeg_size(raw: bytes) -> tuple[int, int, int]:
    """(width, height, components) from the frame header."""
    at = 2
    while at + 9 < len(raw) and raw[:2] == b"\xff\xd8":
        if raw[at] != 0xFF:
            break
        kind = raw[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack(">HHB", raw[at + 5 : at + 10])
            return w, h, n
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    raise Unreadable("not a JPEG")


def write_pictures(pictures: list[np.ndarray | bytes]) -> bytes:
    """A page for each picture; a JPEG's bytes go in as they are."""
    objects, kids = [b"", b"<< >>", b""], []
    for p in pictures:
        extra = ""
        if isinstance(p, bytes):
            w, h, n = jpeg_size(p)
            space = {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
            data, packed, extra = p, False, " /Filter /DCTDecode"
        else:
            h, w = p.shape[:2]
            space, data, packed = "DeviceRGB", p[..., :3].tobytes(), True
            if (p[..., 3] < 255).any():
                objects.append(stream(p[..., 3].tobytes(), f" /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceGray /BitsPerComponent 8"))
                extra = f" /SMask {len(objects)} 0 R"
        objects.append(stream(data, f"{extra} /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8", packed))
        image, scale = len(objects), min(1.0, LONG_SIDE / max(w, h))
        objects.append(stream(b"q %.2f 0 0 %.2f 0 0 cm /I Do Q" % (w * scale, h * scale)))
        objects.append(f"<< /Type /Page /Parent 3 0 R /MediaBox [0 0 {w * scale:.2f} {h * scale:.2f}] /Resources << /XObject << /I {image} 0 R >> >> /Contents {len(objects)} 0 R >>".encode())
        kids.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 3 0 R >>"
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    return assemble(objects)
