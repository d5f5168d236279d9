"""Pictures as arrays of red, green, blue and alpha: PNG, BMP, QOI, Netpbm, Targa, ICO."""

from __future__ import annotations

import base64
import re
import struct
import zlib

import numpy as np

from . import Unreadable

# Largest side and area; sizes of icon sets; brightness ramp.
MAX_SIDE, MAX_AREA = 32768, 64 << 20
ICON_SIZES = {"favicon": (16, 32, 48), "app": (16, 24, 32, 48, 64, 128, 256), "single": (256,)}
RAMP = "@%#*+=-:. "


def sized(width: int, height: int) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and width * height <= MAX_AREA):
        raise Unreadable(f"a picture of {width} x {height}")


def flatten(p: np.ndarray) -> np.ndarray:
    """Alpha over white, as red, green and blue."""
    a = p[..., 3:].astype(np.uint32)
    return ((p[..., :3] * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def _rgba(rgb: np.ndarray) -> np.ndarray:
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], axis=2)


def write_png(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, w * 4)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def _unfiltered(data: bytes, at: int, w: int, h: int, bits: int) -> tuple[np.ndarray, int]:
    """(lines of bytes, place after them) of a picture of ``bits`` a pixel."""
    stride, step = (w * bits + 7) // 8, max(1, bits // 8)
    if len(data) < at + h * (stride + 1):
        raise Unreadable("a short picture")
    rows, above = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = data[at], np.frombuffer(data, np.uint8, stride, at + 1).copy()
        at += stride + 1
        if kind == 2:
            line += above
        elif kind == 1:
            pad = -len(line) % step
            line = np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
        elif kind in (3, 4):
            cur, up = line.tolist(), above.tolist()
            for x in range(stride):
                left, b = cur[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    cur[x] = (cur[x] + (left + b) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(left - c), abs(left + b - 2 * c)
                    cur[x] = (cur[x] + (left if da <= db and da <= dc else b if db <= dc else c)) & 255
            line = np.array(cur, np.uint8)
        rows[y] = above = line
    return rows, at


def _samples(rows: np.ndarray, w: int, depth: int, channels: int, grey: bool) -> np.ndarray:
    """Lines of bytes as samples of eight bits (palette places as they are)."""
    h = len(rows)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : w * channels * depth].reshape(h, -1, depth)
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
        if grey:
            rows = (rows.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return rows.reshape(h, w, channels)


# The seven passes of an interlaced PNG as first column and line, and steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def read_png(raw: bytes) -> np.ndarray:
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise Unreadable("not a PNG")
    at, parts, palette, alpha, head = 8, [], None, b"", None
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = data
        elif kind == b"IDAT":
            parts.append(data)
        at += n + 12
    if head is None:
        raise Unreadable("no header")
    w, h, depth, colour, _, _, interlaced = head
    sized(w, h)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or depth not in (1, 2, 4, 8, 16):
        raise Unreadable("an unknown PNG kind")
    try:
        most = (w * channels * depth + 15) // 8 * h * 2 + 8 * h
        data = zlib.decompressobj().decompress(b"".join(parts), most)
    except zlib.error as e:
        raise Unreadable(str(e)) from None
    p, at = np.zeros((h, w, channels), np.uint8), 0
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        pw, ph = len(range(x, w, dx)), len(range(y, h, dy))
        if pw and ph:
            rows, at = _unfiltered(data, at, pw, ph, channels * depth)
            p[y::dy, x::dx] = _samples(rows, pw, depth, channels, colour == 0)
    if colour == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        if palette is None:
            raise Unreadable("no palette")
        table[: len(palette), :3] = palette
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        return table[p[..., 0]]
    if colour in (0, 4):
        grey = np.repeat(p[..., :1], 3, axis=2)
        return np.concatenate([grey, p[..., 1:]], axis=2) if colour == 4 else _rgba(grey)
    return p if colour == 6 else _rgba(p)


def write_bmp(p: np.ndarray) -> bytes:
    rgb = flatten(p)[::-1, :, ::-1]
    h, w = rgb.shape[:2]
    body = np.pad(rgb.reshape(h, w * 3), ((0, 0), (0, -w * 3 % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _dib(raw: bytes, at: int | None, half: bool = False) -> np.ndarray:
    """A bitmap header with pixels at ``at`` or right after it; ``half``: the
    height counts a mask of as many lines too."""
    size, w, h, _, depth, packing = struct.unpack("<IiiHHI", raw[:20])
    used = struct.unpack("<I", raw[32:36])[0]
    down, h = h < 0, abs(h) // (2 if half else 1)
    sized(w, h)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise Unreadable("a packed bitmap")
    colours = (used or 1 << depth) if depth <= 8 else 0
    at = size + 4 * colours + (12 if packing == 3 and size == 40 else 0) if at is None else at
    stride = (w * depth + 31) // 32 * 4
    if len(raw) < at + stride * h:
        raise Unreadable("a short bitmap")
    rows = np.frombuffer(raw, np.uint8, stride * h, at).reshape(h, stride)
    if depth <= 8:
        table = np.frombuffer(raw, np.uint8, 4 * colours, size).reshape(-1, 4)[:, [2, 1, 0]]
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        index = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)
        p = _rgba(table[np.minimum(index, colours - 1)])
    elif depth == 24:
        p = _rgba(rows[:, : w * 3].reshape(h, w, 3)[..., ::-1])
    else:
        p = rows.reshape(h, w, 4)[..., [2, 1, 0, 3]].copy()
        if not p[..., 3].any():
            p[..., 3] = 255
    if half:
        mask_at, mask_stride = at + stride * h, (w + 31) // 32 * 4
        if depth != 32 and len(raw) >= mask_at + mask_stride * h:
            mask = np.unpackbits(np.frombuffer(raw, np.uint8, mask_stride * h, mask_at).reshape(h, -1), axis=1)[:, :w]
            p = p.copy()
            p[..., 3] = np.where(mask, 0, 255)
    return p if down else p[::-1]


def read_bmp(raw: bytes) -> np.ndarray:
    if raw[:2] != b"BM" or len(raw) < 54:
        raise Unreadable("not a bitmap")
    return _dib(raw[14:], struct.unpack("<I", raw[10:14])[0] - 14)


def _qoi_place(p: tuple[int, int, int, int]) -> int:
    return (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64


def write_qoi(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    out = bytearray(b"qoif" + struct.pack(">IIBB", w, h, 4, 0))
    last, seen, run = (0, 0, 0, 255), [(0, 0, 0, 0)] * 64, 0
    for px in map(tuple, p.reshape(-1, 4).tolist()):
        if px == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        k = _qoi_place(px)
        if seen[k] == px:
            out.append(k)
        else:
            seen[k] = px
            r, g, b = ((px[i] - last[i] + 128) % 256 - 128 for i in range(3))
            if px[3] != last[3]:
                out += bytes([0xFF, *px])
            elif -2 <= r <= 1 and -2 <= g <= 1 and -2 <= b <= 1:
                out.append(0x40 | r + 2 << 4 | g + 2 << 2 | b + 2)
            elif -32 <= g <= 31 and -8 <= r - g <= 7 and -8 <= b - g <= 7:
                out += bytes([0x80 | g + 32, r - g + 8 << 4 | b - g + 8])
            else:
                out += bytes([0xFE, *px[:3]])
        last = px
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + b"\0\0\0\0\0\0\0\1"


def read_qoi(raw: bytes) -> np.ndarray:
    if raw[:4] != b"qoif" or len(raw) < 14:
        raise Unreadable("not a QOI picture")
    w, h = struct.unpack(">II", raw[4:12])
    sized(w, h)
    out, px, seen, at = bytearray(), (0, 0, 0, 255), [(0, 0, 0, 0)] * 64, 14
    while len(out) < 4 * w * h:
        if at >= len(raw):
            raise Unreadable("a short picture")
        op, run = raw[at], 1
        at += 1
        if op == 0xFF:
            px, at = tuple(raw[at : at + 4]), at + 4
        elif op == 0xFE:
            px, at = (*raw[at : at + 3], px[3]), at + 3
        elif op >> 6 == 0:
            px = seen[op]
        elif op >> 6 == 1:
            px = ((px[0] + (op >> 4 & 3) - 2) & 255, (px[1] + (op >> 2 & 3) - 2) & 255, (px[2] + (op & 3) - 2) & 255, px[3])
        elif op >> 6 == 2:
            g, two = (op & 63) - 32, raw[at]
            at += 1
            px = ((px[0] + g + (two >> 4) - 8) & 255, (px[1] + g) & 255, (px[2] + g + (two & 15) - 8) & 255, px[3])
        else:
            run = (op & 63) + 1
        seen[_qoi_place(px)] = px
        out += bytes(px) * run
    return np.frombuffer(bytes(out[: 4 * w * h]), np.uint8).reshape(h, w, 4)


def write_pnm(p: np.ndarray) -> bytes:
    return f"P6\n{p.shape[1]} {p.shape[0]}\n255\n".encode() + flatten(p).tobytes()


def read_pnm(raw: bytes) -> np.ndarray:
    kind = raw[:2].decode("latin-1")
    if not re.fullmatch("P[1-6]", kind):
        raise Unreadable("not a Netpbm picture")
    at, head = 2, []
    while len(head) < (2 if kind in ("P1", "P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not m:
            raise Unreadable("a short header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    sized(w, h)
    top, n = head[2] if len(head) > 2 else 1, w * h * (3 if kind in ("P3", "P6") else 1)
    if not 0 < top < 65536:
        raise Unreadable("a wrong maximum")
    if kind in ("P1", "P2", "P3"):
        body = re.sub(rb"#[^\n]*", b"", raw[at:])
        tokens = re.findall(rb"[01]" if kind == "P1" else rb"\d+", body)[:n]
        v = np.array(list(map(int, tokens)), np.uint32)
    elif kind == "P4":
        v = np.unpackbits(np.frombuffer(raw, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w].ravel().astype(np.uint32)
    else:
        v = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, at + 1).astype(np.uint32)
    if len(v) < n:
        raise Unreadable("a short picture")
    v = 1 - v if kind in ("P1", "P4") else v
    v = (np.minimum(v, top) * 255 // top).astype(np.uint8).reshape(h, w, -1)
    return _rgba(v if v.shape[2] == 3 else np.repeat(v, 3, axis=2))


def write_tga(p: np.ndarray) -> bytes:
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, p.shape[1], p.shape[0], 32, 0x28) + p[..., [2, 1, 0, 3]].tobytes()


def read_tga(raw: bytes) -> np.ndarray:
    if len(raw) < 18:
        raise Unreadable("not a Targa picture")
    skip, mapped, kind, first, entries, bits, _, _, w, h, depth, flags = struct.unpack("<BBBHHBHHHHBB", raw[:18])
    if kind & ~8 not in (1, 2, 3) or depth not in (8, 15, 16, 24, 32):
        raise Unreadable("an unknown Targa kind")
    sized(w, h)
    at, step = 18 + skip, (depth + 7) // 8

    def colours(b: np.ndarray, depth: int) -> np.ndarray:
        if depth in (15, 16):
            v = b.reshape(-1, 2).astype(np.uint32)
            v = v[:, 0] | v[:, 1] << 8
            five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=1)
            return np.concatenate([(five * 255 // 31), np.full((len(v), 1), 255)], axis=1).astype(np.uint8)
        b = b.reshape(-1, depth // 8)
        if depth == 8:
            return np.concatenate([np.repeat(b, 3, axis=1), np.full((len(b), 1), 255, np.uint8)], axis=1)
        return b[:, [2, 1, 0, 3]] if depth == 32 else np.concatenate([b[:, ::-1], np.full((len(b), 1), 255, np.uint8)], axis=1)

    table = None
    if mapped:
        n = entries * ((bits + 7) // 8)
        table, at = colours(np.frombuffer(raw, np.uint8, n, at), bits), at + n
    need = w * h * step
    if kind & 8:
        out = bytearray()
        while len(out) < need:
            if at >= len(raw):
                raise Unreadable("a short picture")
            n = (raw[at] & 127) + 1
            if raw[at] & 128:
                out += raw[at + 1 : at + 1 + step] * n
                at += 1 + step
            else:
                out += raw[at + 1 : at + 1 + n * step]
                at += 1 + n * step
        body = np.frombuffer(bytes(out[:need]), np.uint8)
    elif len(raw) < at + need:
        raise Unreadable("a short picture")
    else:
        body = np.frombuffer(raw, np.uint8, need, at)
    p = (table[np.clip(body.astype(int) - first, 0, len(table) - 1)] if table is not None else colours(body, depth)).reshape(h, w, 4)
    p = p if flags & 0x20 else p[::-1]
    return p[:, ::-1] if flags & 0x10 else p


def resized(p: np.ndarray, w: int, h: int) -> np.ndarray:
    """Mean of the covered area, alpha weighted."""
    def edges(n: int, m: int) -> np.ndarray:
        cover = np.zeros((m, n))
        for i in range(m):
            a, b = i * n / m, (i + 1) * n / m
            for j in range(int(a), min(n, int(np.ceil(b)))):
                cover[i, j] = min(b, j + 1) - max(a, j)
        return cover / cover.sum(axis=1, keepdims=True)

    q = p.astype(np.float64)
    q[..., :3] *= q[..., 3:] / 255
    q = np.einsum("ij,jkc->ikc", edges(p.shape[0], h), np.einsum("ij,kjc->kic", edges(p.shape[1], w), q))
    q[..., :3] = np.divide(q[..., :3] * 255, q[..., 3:], out=np.zeros_like(q[..., :3]), where=q[..., 3:] > 0)
    return np.clip(np.rint(q), 0, 255).astype(np.uint8)


def write_ico(p: np.ndarray, sizes: str = "favicon") -> bytes:
    pictures = []
    for s in ICON_SIZES.get(sizes, ICON_SIZES["favicon"]):
        scale = min(s / p.shape[1], s / p.shape[0])
        small = resized(p, max(1, round(p.shape[1] * scale)), max(1, round(p.shape[0] * scale)))
        whole = np.zeros((s, s, 4), np.uint8)
        y, x = (s - small.shape[0]) // 2, (s - small.shape[1]) // 2
        whole[y : y + small.shape[0], x : x + small.shape[1]] = small
        pictures.append((s, write_png(whole)))
    at, head = 6 + 16 * len(pictures), struct.pack("<HHH", 0, 1, len(pictures))
    for s, data in pictures:
        head += struct.pack("<BBBBHHII", s % 256, s % 256, 0, 0, 1, 32, len(data), at)
        at += len(data)
    return head + b"".join(d for _, d in pictures)


def read_ico(raw: bytes) -> np.ndarray:
    if len(raw) < 6 or raw[:4] != b"\0\0\1\0":
        raise Unreadable("not an icon")
    n = struct.unpack("<H", raw[4:6])[0]
    entries = [struct.unpack("<BBBBHHII", raw[6 + 16 * i : 22 + 16 * i]) for i in range(n) if len(raw) >= 22 + 16 * i]
    if not entries:
        raise Unreadable("an empty icon")
    w, _, _, _, _, depth, size, at = max(entries, key=lambda e: (e[0] or 256, e[5]))
    data = raw[at : at + size]
    return read_png(data) if data[:4] == b"\x89PNG" else _dib(data, None, half=True)


READERS = {"png": read_png, "bmp": read_bmp, "qoi": read_qoi, "pnm": read_pnm, "tga": read_tga, "ico": read_ico}
WRITERS = {"png": write_png, "bmp": write_bmp, "qoi": write_qoi, "pnm": write_pnm, "tga": write_tga, "ico": write_ico}


def svg(raw: bytes, kind: str, w: int, h: int) -> bytes:
    """A vector file that holds the picture's bytes at its size."""
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}"><image width="{w}" height="{h}" '
        f'href="data:image/{kind};base64,{base64.b64encode(raw).decode()}"/></svg>\n'
    ).encode()


def to_text(p: np.ndarray, columns: int = 100) -> bytes:
    """Ten steps of brightness, twice as high as wide."""
    w = min(columns, p.shape[1])
    h = max(1, round(p.shape[0] * w / p.shape[1] / 2))
    small = flatten(resized(p, w, h)).astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    index = np.minimum((small / 255 * len(RAMP)).astype(int), len(RAMP) - 1)
    return "".join("".join(RAMP[i] for i in row).rstrip() + "\n" for row in index).encode()
