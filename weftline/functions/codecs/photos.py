"""Pictures of few colours (GIF), with tags (TIFF) and by cosine transform (JPEG)."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

from . import Unreadable
from .images import flatten, sized

# ---- GIF


def _palette(p: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(colours, index of each pixel): exact for few colours, else by splitting the
    box of most spread at its median."""
    flat = p[..., :3].reshape(-1, 3)
    colours, where, count = np.unique(flat, axis=0, return_inverse=True, return_counts=True)
    where = where.ravel()
    if len(colours) <= most:
        return colours.astype(np.uint8), where
    spread = lambda ix: (-int((np.ptp(colours[ix], axis=0).max() + 1) * np.log1p(count[ix].sum()) * 1000), ix[0], ix)
    boxes = [spread(np.arange(len(colours)))]
    while len(boxes) < most:
        _, _, ix = heapq.heappop(boxes)
        if len(ix) < 2:
            heapq.heappush(boxes, (0, ix[0], ix))
            break
        axis = int(np.ptp(colours[ix], axis=0).argmax())
        ix = ix[np.argsort(colours[ix, axis], kind="stable")]
        half = np.cumsum(count[ix])
        k = min(max(1, int(np.searchsorted(half, half[-1] / 2))), len(ix) - 1)
        for part in (ix[:k], ix[k:]):
            heapq.heappush(boxes, spread(part))
    table, of = np.zeros((len(boxes), 3), np.uint8), np.zeros(len(colours), np.int64)
    for i, (_, _, ix) in enumerate(boxes):
        table[i] = np.rint(np.average(colours[ix], axis=0, weights=count[ix]))
        of[ix] = i
    return table, of[where]


def _lzw_pack(data: bytes, bits: int) -> bytes:
    clear, out, held, n = 1 << bits, bytearray(), 0, 0
    width, codes = bits + 1, {}

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += width
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    last, following = -1, clear + 2
    for c in data:
        if last < 0:
            last = c
        elif (last, c) in codes:
            last = codes[last, c]
        else:
            put(last)
            if following < 4096:
                codes[last, c] = following
                following += 1
                if following > 1 << width and width < 12:
                    width += 1
            else:
                put(clear)
                codes, width, following = {}, bits + 1, clear + 2
            last = c
    if last >= 0:
        put(last)
    put(clear + 1)
    if n:
        out.append(held & 255)
    return bytes(out)


def _lzw_unpack(data: bytes, bits: int, need: int, high_first: bool = False) -> bytes:
    """Codes from the low bit up as in GIF, or from the high bit down with an early
    change of width as in TIFF."""
    clear, out = 1 << bits, bytearray()
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last = list(base), bits + 1, b""
    held = n = 0
    for byte in data:
        held, n = (held << 8 | byte, n + 8) if high_first else (held | byte << n, n + 8)
        while n >= width:
            if high_first:
                code = held >> (n - width)
                held &= (1 << (n - width)) - 1
            else:
                code = held & (1 << width) - 1
                held >>= width
            n -= width
            if code == clear:
                table, width, last = list(base), bits + 1, b""
                continue
            if code == clear + 1 or len(out) >= need:
                return bytes(out[:need])
            if code < len(table):
                piece = table[code]
            elif last and code == len(table):
                piece = last + last[:1]
            else:
                raise Unreadable("a wrong code")
            out += piece
            if last and len(table) < 4096:
                table.append(last + piece[:1])
            last = piece
            if len(table) + high_first >= 1 << width and width < 12:
                width += 1
    return bytes(out[:need])


def write_gif(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    clear = p[..., 3].ravel() < 128
    table, index = _palette(p, 255 if clear.any() else 256)
    if clear.any():
        index = np.where(clear, len(table), index)
        table = np.concatenate([table, np.zeros((1, 3), np.uint8)])
    bits = max(2, (len(table) - 1).bit_length())
    full = np.zeros((1 << bits, 3), np.uint8)
    full[: len(table)] = table
    body = _lzw_pack(index.astype(np.uint8).tobytes(), bits)
    blocks = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
    control = b"\x21\xf9\x04\x01\0\0" + bytes([len(table) - 1, 0]) if clear.any() else b""
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 0x70 | bits - 1, 0, 0) + full.tobytes() + control + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits]) + blocks + b"\0;"


def read_gif(raw: bytes) -> np.ndarray:
    """The first picture."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 14:
        raise Unreadable("not a GIF")
    w, h, flags = struct.unpack("<HHB", raw[6:11])
    sized(w, h)
    at, shared, clear = 13, None, -1
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        out = bytearray()
        while at < len(raw) and raw[at]:
            out += raw[at + 1 : at + 1 + raw[at]]
            at += raw[at] + 1
        return bytes(out), at + 1

    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            data, after = blocks(at + 2)
            if raw[at + 1] == 0xF9 and data and data[0] & 1:
                clear = data[3]
            at = after
        elif raw[at] == 0x2C:
            x, y, pw, ph, own = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
            at += 10
            table = shared
            if own & 0x80:
                n = 2 << (own & 7)
                table, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            if table is None or not 2 <= raw[at] <= 8:
                raise Unreadable("no colours")
            data = _lzw_unpack(blocks(at + 1)[0], raw[at], pw * ph)
            index = np.frombuffer(data.ljust(pw * ph, b"\0"), np.uint8).reshape(ph, pw)
            if own & 0x40:
                order = [*range(0, ph, 8), *range(4, ph, 8), *range(2, ph, 4), *range(1, ph, 2)]
                index = index[np.argsort(order)]
            out = np.zeros((h, w, 4), np.uint8)
            view = out[y : y + ph, x : x + pw]
            index = index[: view.shape[0], : view.shape[1]]
            view[..., :3] = table[np.minimum(index, len(table) - 1)]
            view[..., 3] = np.where(index == clear, 0, 255)
            return out
        else:
            break
    raise Unreadable("no picture")


# ---- TIFF


def write_tiff(p: np.ndarray) -> bytes:
    """One strip of red, green, blue and alpha, deflated."""
    h, w = p.shape[:2]
    body = zlib.compress(p.tobytes(), 9)
    tags = [(256, 4, w), (257, 4, h), (258, 3, None), (259, 3, 8), (262, 3, 2), (273, 4, 8), (277, 3, 4), (278, 4, h), (279, 4, len(body)), (338, 3, 2)]
    body += b"\0" * (len(body) % 2)
    depth_at = 8 + len(body)
    entry = lambda t, k, v: struct.pack("<HHI", t, k, 4 if v is None else 1) + struct.pack("<I", depth_at if v is None else v)
    return struct.pack("<2sHI", b"II", 42, depth_at + 8) + body + struct.pack("<4H", 8, 8, 8, 8) + struct.pack("<H", len(tags)) + b"".join(entry(*t) for t in tags) + b"\0\0\0\0"


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def read_tiff(raw: bytes) -> np.ndarray:
    """The first picture: grey, colour or colour map, in strips, plain or packed."""
    e = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if e is None or len(raw) < 8 or struct.unpack(e + "H", raw[2:4])[0] != 42:
        raise Unreadable("not a TIFF")
    at = struct.unpack(e + "I", raw[4:8])[0]
    tags: dict[int, list[int]] = {}
    try:
        for i in range(struct.unpack(e + "H", raw[at : at + 2])[0]):
            tag, kind, n, _ = struct.unpack(e + "HHII", raw[at + 2 + 12 * i : at + 14 + 12 * i])
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size and n <= 1 << 20:
                place = at + 10 + 12 * i if size * n <= 4 else struct.unpack(e + "I", raw[at + 10 + 12 * i : at + 14 + 12 * i])[0]
                tags[tag] = list(struct.unpack(f"{e}{n}{'BHI'[size // 2]}", raw[place : place + size * n]))
    except struct.error:
        raise Unreadable("a short file") from None
    one = lambda t, d: tags.get(t, [d])[0]
    w, h, packing, colour, samples, depth = one(256, 0), one(257, 0), one(259, 1), one(262, 1), one(277, 1), one(258, 1)
    sized(w, h)
    if 322 in tags or one(284, 1) != 1 or depth not in (1, 8) or colour not in (0, 1, 2, 3) or (depth == 1 and samples > 1):
        raise Unreadable("an unknown TIFF kind")
    stride, per = (w * samples * depth + 7) // 8, min(one(278, h), h)
    data = bytearray()
    for k, (start, size) in enumerate(zip(tags.get(273, []), tags.get(279, []), strict=False)):
        piece, need = raw[start : start + size], stride * min(per, h - k * per)
        if packing == 1:
            data += piece[:need]
        elif packing in (8, 32946):
            data += zlib.decompressobj().decompress(piece, need)
        elif packing == 5:
            data += _lzw_unpack(piece, 8, need, high_first=True)
        elif packing == 32773:
            data += _packbits(piece)[:need]
        else:
            raise Unreadable("an unknown packing")
    if len(data) < stride * h:
        raise Unreadable("a short picture")
    rows = np.frombuffer(bytes(data[: stride * h]), np.uint8).reshape(h, stride)
    v = np.unpackbits(rows, axis=1)[:, :w, None] * (255 if colour < 2 else 1) if depth == 1 else rows.reshape(h, w, samples)
    if one(317, 1) == 2:
        v = np.cumsum(v, axis=1, dtype=np.uint8)
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        table = np.array(tags.get(320, []), np.uint32).reshape(3, -1) >> 8
        out[..., :3] = table.T[v[..., 0]]
    elif colour == 2:
        out[..., :3] = v[..., :3]
    else:
        out[..., :3] = v[..., :1] if colour else 255 - v[..., :1]
    extra = 3 if colour == 2 else 1
    if samples > extra and one(338, 0):
        out[..., 3] = v[..., extra]
    return out


# ---- JPEG

# The usual quantisers of brightness and colour.
LUMA = (
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 "
    "49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
)
CHROMA = "17 18 24 47 18 21 26 66 24 26 56 99 47 66 99 99"


def _zigzag() -> np.ndarray:
    """Places of a block along its diagonals."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _cosines() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def quantisers(quality: int) -> list[np.ndarray]:
    """Tables for a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = np.array(list(map(int, CHROMA.split()))).reshape(4, 4)
    luma = np.array(list(map(int, LUMA.split()))).reshape(8, 8)
    return [np.clip((t * scale + 50) // 100, 1, 255) for t in (luma, chroma)]


def code_lengths(count: Counter, most: int = 16, spare: bool = True) -> dict[int, int]:
    """Prefix code lengths of at most ``most`` bits; over-long codes are evened out.
    With ``spare``, a place is kept for one more symbol, so no code is of ones only."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(count.items()))] + [(0, -1, [-1])] * spare
    heapq.heapify(heap)
    depth = Counter()
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    lengths = sorted(depth.values())
    while lengths[-1] > most:
        # The longest pair gives a bit up: its parent takes one, the other goes under a shorter code.
        top = lengths[-1]
        lengths.remove(top)
        lengths.remove(top)
        j = max(x for x in lengths if x < top - 1)
        lengths.remove(j)
        lengths = sorted([*lengths, top - 1, j + 1, j + 1])
    order = sorted(count, key=lambda s: (-count[s], s))
    return dict(zip(order, lengths, strict=False))


def _codes(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """(symbol -> (code, bits), table segment body)."""
    by = sorted(lengths, key=lambda s: (lengths[s], s))
    out, code, last = {}, 0, 0
    for s in by:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    sizes = Counter(lengths.values())
    return out, bytes(sizes.get(i, 0) for i in range(1, 17)) + bytes(by)


def write_jpg(p: np.ndarray, quality: int = 85) -> bytes:
    """A baseline file over white, without subsampling, with codes of its own."""
    rgb = flatten(p).astype(np.float64)
    h, w = rgb.shape[:2]
    m = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    ycc = np.pad(rgb @ m.T + [-128, 0, 0], ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    tables, c, zz = quantisers(min(max(quality, 1), 100)), _cosines(), _zigzag()
    blocks = ycc.reshape(ycc.shape[0] // 8, 8, -1, 8, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, 8, 8)
    coded = np.stack([np.rint(c @ blocks[:, i] @ c.T / tables[min(i, 1)]) for i in range(3)], axis=1).astype(int).reshape(-1, 3, 64)[..., zz]
    marks: list[tuple[int, int, int, int]] = []  # table, symbol, bits, value
    last = [0, 0, 0]
    for block in coded:
        for i in range(3):
            t, values = min(i, 1), block[i].tolist()
            d, last[i] = values[0] - last[i], values[0]
            n = abs(d).bit_length()
            marks.append((t, n, n, d if d >= 0 else d + (1 << n) - 1))
            run = 0
            for v in values[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    marks.append((2 + t, 0xF0, 0, 0))
                    run -= 16
                n = abs(v).bit_length()
                marks.append((2 + t, run << 4 | n, n, v if v >= 0 else v + (1 << n) - 1))
                run = 0
            if run:
                marks.append((2 + t, 0, 0, 0))
    made = [_codes(code_lengths(Counter(s for t, s, _, _ in marks if t == k) or Counter({0: 1}))) for k in range(4)]
    held = n = 0
    body = bytearray()
    for t, s, size, value in marks:
        code, bits = made[t][0][s]
        held, n = (held << bits | code) << size | value, n + bits + size
        while n >= 8:
            byte = held >> (n - 8) & 255
            body.append(byte)
            if byte == 255:
                body.append(0)
            n -= 8
        held &= (1 << n) - 1
    if n:
        byte = (held << (8 - n) | (1 << (8 - n)) - 1) & 255
        body += bytes([byte, 0] if byte == 255 else [byte])
    seg = lambda k, d: struct.pack(">BBH", 255, k, len(d) + 2) + d
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(seg(0xDB, bytes([i]) + bytes(t.ravel()[zz].tolist())) for i, t in enumerate(tables))
    head += seg(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += b"".join(seg(0xC4, bytes([k & 1 | (k >> 1) << 4]) + made[k][1]) for k in range(4))
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + bytes(body) + b"\xff\xd9"


# Markers within a scan, and those that end one.
RESTARTS = frozenset(range(0xD0, 0xD8))
MARKERS = frozenset(range(0xC0, 0xFF)) - RESTARTS


class _Bits:
    """The entropy-coded bits of a JPEG scan; zeros follow where a marker ends it."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at, self.held, self.n = raw, at, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            if self.at >= len(self.raw):
                raise Unreadable("a short picture")
            b = self.raw[self.at]
            if b != 255:
                self.at += 1
            elif self.raw[self.at + 1 : self.at + 2] == b"\0":
                self.at += 2
            else:
                b = 0
            self.held, self.n = self.held << 8 | b, self.n + 8
        self.n -= k
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v

    def symbol(self, table: dict) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := table.get((bits, code))) is not None:
                return s
        raise Unreadable("a wrong code")

    def value(self, k: int) -> int:
        v = self.take(k) if k else 0
        return v if not k or v >> (k - 1) else v - (1 << k) + 1

    def to_marker(self, kinds: frozenset[int]) -> None:
        """Go to the next marker of the kinds; what is held is dropped."""
        self.held = self.n = 0
        while self.at + 1 < len(self.raw) and not (self.raw[self.at] == 255 and self.raw[self.at + 1] in kinds):
            self.at += 1


@dataclass
class _Part:
    """One colour of a JPEG: its coefficients by block, as whole units of the picture."""

    across: int
    down: int
    quantiser: int
    shape: tuple[int, int]
    blocks: np.ndarray


class _Pass:
    """One scan over places first..last of the blocks, at ``low`` bits above the
    lowest; ``high`` is the bit that an earlier scan ended at, 0 for none."""

    def __init__(self, bits: _Bits, first: int, last: int, high: int, low: int):
        self.bits, self.first, self.last, self.high, self.low = bits, first, last, high, low
        self.zz, self.empty, self.before = _zigzag().tolist(), 0, {}

    def block(self, b: list[int], i: int, dc: dict, ac: dict) -> None:
        if self.first == 0:
            if self.high:
                b[0] |= self.bits.take(1) << self.low
            else:
                self.before[i] = self.before.get(i, 0) + self.bits.value(self.bits.symbol(dc))
                b[0] = self.before[i] << self.low
        if self.last:
            (self._refined if self.high else self._new)(b, ac, max(self.first, 1))

    def _run(self, r: int) -> int:
        """Blocks without a further value, this one included."""
        return (1 << r) + self.bits.take(r)

    def _new(self, b: list[int], ac: dict, k: int) -> None:
        while k <= self.last and not self.empty:
            r, size = divmod(self.bits.symbol(ac), 16)
            if size:
                k += r
                if k > self.last:
                    raise Unreadable("a wrong run")
                b[self.zz[k]] = self.bits.value(size) * (1 << self.low)
                k += 1
            elif r == 15:
                k += 16
            else:
                self.empty = self._run(r)
        self.empty -= self.empty > 0

    def _refined(self, b: list[int], ac: dict, k: int) -> None:
        while k <= self.last:
            zeros, made = 64, 0  # an empty block: only what is known gets its bit
            if not self.empty:
                zeros, size = divmod(self.bits.symbol(ac), 16)
                if size:
                    made = 1 if self.bits.take(1) else -1
                elif zeros < 15:
                    self.empty, zeros = self._run(zeros), 64
            while k <= self.last:
                z, k = self.zz[k], k + 1
                if b[z]:
                    if self.bits.take(1):
                        b[z] += (1 if b[z] > 0 else -1) << self.low
                elif zeros:
                    zeros -= 1
                else:
                    b[z] = made * (1 << self.low)
                    break
        self.empty -= self.empty > 0


def _code_tables(data: bytes) -> dict[int, dict]:
    out = {}
    while len(data) > 16:
        code, k, table = 0, 17, {}
        for bits in range(1, 17):
            for _ in range(data[bits]):
                if k >= len(data):
                    raise Unreadable("a short table")
                table[bits, code] = data[k]
                code, k = code + 1, k + 1
            code <<= 1
        out[data[0]], data = table, data[k:]
    return out


def _scan(raw: bytes, at: int, head: bytes, parts: dict[int, _Part], codes: dict[int, dict], every: int) -> int:
    """Decode one scan into its parts' blocks; the place of the marker after it."""
    n = head[0]
    if len(head) < 4 + 2 * n or any(head[1 + 2 * i] not in parts for i in range(n)):
        raise Unreadable("an unknown JPEG kind")
    first, last, bit = head[1 + 2 * n : 4 + 2 * n]
    if not first <= last < 64 or (first and n > 1):
        raise Unreadable("a wrong scan")
    use = [(parts[head[1 + 2 * i]], codes.get(head[2 + 2 * i] >> 4, {}), codes.get(16 | head[2 + 2 * i] & 15, {})) for i in range(n)]
    run = _Pass(_Bits(raw, at), first, last, bit >> 4, bit & 15)
    if n == 1:  # a part by itself has no blocks beyond the picture's edge
        down, across = use[0][0].shape
    else:
        across = use[0][0].blocks.shape[1] // use[0][0].across
        down = use[0][0].blocks.shape[0] // use[0][0].down
    for unit in range(across * down):
        if every and unit and unit % every == 0:
            run.bits.to_marker(RESTARTS)
            run.bits.at += 2
            run.before, run.empty = {}, 0
        y, x = divmod(unit, across)
        for i, (part, dc, ac) in enumerate(use):
            high, wide = (1, 1) if n == 1 else (part.down, part.across)
            for by in range(y * high, (y + 1) * high):
                for bx in range(x * wide, (x + 1) * wide):
                    b = part.blocks[by, bx].tolist()
                    run.block(b, i, dc, ac)
                    part.blocks[by, bx] = b
    run.bits.to_marker(MARKERS)
    return run.bits.at


def read_jpg(raw: bytes) -> np.ndarray:
    """A file of one or several scans, baseline or progressive, of grey, colour or
    four inks."""
    if raw[:2] != b"\xff\xd8":
        raise Unreadable("not a JPEG")
    at, tables, codes, every, adobe, w, h = 2, {}, {}, 0, None, 0, 0
    parts: dict[int, _Part] = {}
    scans, zz = 0, _zigzag()
    while at + 4 <= len(raw):
        if raw[at] != 255:
            raise Unreadable("a wrong marker")
        kind = raw[at + 1]
        if kind == 255:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        data, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while data:
                wide, i = data[0] >> 4, data[0] & 15
                n = 128 if wide else 64
                if len(data) <= n:
                    raise Unreadable("a short table")
                table = np.zeros(64)
                table[zz] = np.frombuffer(data[1 : 1 + n], ">u2" if wide else np.uint8)
                tables[i], data = table.reshape(8, 8), data[1 + n :]
        elif kind == 0xC4:
            codes |= _code_tables(data)
        elif kind in (0xC0, 0xC1, 0xC2):
            if parts or len(data) < 6 or data[0] != 8 or len(data) < 6 + 3 * data[5]:
                raise Unreadable("an unknown JPEG kind")
            h, w, n = struct.unpack(">HHB", data[1:6])
            sized(w, h)
            given = [(data[6 + 3 * i], data[7 + 3 * i] >> 4, data[7 + 3 * i] & 15, data[8 + 3 * i]) for i in range(n)]
            if n not in (1, 3, 4) or not all(0 < x < 5 and 0 < y < 5 for _, x, y, _ in given):
                raise Unreadable("an unknown JPEG kind")
            if n == 1:
                given = [(given[0][0], 1, 1, given[0][3])]
            big_x, big_y = max(g[1] for g in given), max(g[2] for g in given)
            units = -(-h // (8 * big_y)), -(-w // (8 * big_x))
            for ident, x, y, q in given:
                seen = -(-(-(-h * y // big_y)) // 8), -(-(-(-w * x // big_x)) // 8)
                parts[ident] = _Part(x, y, q, seen, np.zeros((units[0] * y, units[1] * x, 64), np.int32))
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise Unreadable("an unknown JPEG kind")
        elif kind == 0xDD:
            every = struct.unpack(">H", data[:2])[0]
        elif kind == 0xEE and data[:5] == b"Adobe" and len(data) > 11:
            adobe = data[11]
        elif kind == 0xDA:
            if not parts or not data:
                raise Unreadable("an unknown JPEG kind")
            at, scans = _scan(raw, at, data, parts, codes, every), scans + 1
    if not scans or any(p.quantiser not in tables for p in parts.values()):
        raise Unreadable("no picture")
    c = _cosines()
    full = []
    for part in parts.values():
        px = c.T @ (part.blocks.reshape(*part.blocks.shape[:2], 8, 8) * tables[part.quantiser]) @ c + 128
        px = px.transpose(0, 2, 1, 3).reshape(part.blocks.shape[0] * 8, -1)
        full.append(px[np.arange(h) * part.down // big_y][:, np.arange(w) * part.across // big_x])
    if len(full) == 1:
        rgb = np.repeat(full[0][..., None], 3, axis=2)
    elif adobe == 0 or (len(full) == 4 and adobe is None):
        rgb = np.stack(full[:3], axis=2)
    else:
        luma, cb, cr = full[0], full[1] - 128, full[2] - 128
        rgb = np.stack([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], axis=2)
    rgb = np.clip(np.rint(rgb), 0, 255)
    if len(full) == 4:  # inks are stored as what they leave of the light
        rgb = np.rint(rgb * np.clip(np.rint(full[3]), 0, 255)[..., None] / 255)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = rgb
    return out
