"""Lossless WebP pictures (the VP8L bit stream); lossy ones aren't read."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

from . import Unreadable
from .images import sized
from .photos import code_lengths

# Alphabets of a group's five codes (green also has a colour cache),
# the order in which lengths of the length code come, and the cache's multiplier.
GREEN, CHANNEL, DISTANCE = 256 + 24, 256, 40
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = 0x1E35A7BD
#: Offsets of the short distances: nearest first, then the narrower, then the right one.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda o: (o[0] ** 2 + o[1] ** 2, abs(o[0]), -o[0]))


class _Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.n = raw, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            if self.at >= len(self.raw):
                raise Unreadable("a short picture")
            self.held |= int.from_bytes(self.raw[self.at : self.at + 4], "little") << self.n
            self.n += 8 * len(self.raw[self.at : self.at + 4])
            self.at += 4
        v = self.held & ((1 << k) - 1)
        self.held, self.n = self.held >> k, self.n - k
        return v

    def symbol(self, code: dict | int) -> int:
        if isinstance(code, int):
            return code
        at = 1
        while True:
            at = at << 1 | self.take(1)
            if (s := code.get(at)) is not None:
                return s
            if at > 1 << 16:
                raise Unreadable("a wrong code")


def _code(lengths: dict[int, int]) -> dict | int:
    """Codes, each behind a leading 1, to symbols; a single symbol needs no bit."""
    if len(lengths) == 1:
        return next(iter(lengths))
    if sum(1 << (15 - n) for n in lengths.values()) != 1 << 15:
        raise Unreadable("a wrong code")
    return {1 << n | c: s for s, (c, n) in _numbered(lengths).items()}


def _numbered(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), by length and symbol."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s], last, code = (code, n), n, code + 1
    return out


def _read_code(bits: _Bits, alphabet: int) -> dict | int:
    if bits.take(1):
        both, wide = bits.take(1), bits.take(1)
        found = [bits.take(8 if wide else 1), *([bits.take(8)] if both else [])]
        if max(found) >= alphabet:
            raise Unreadable("a wrong code")
        return _code(dict.fromkeys(found, 1))
    lengths = {s: n for s in LENGTH_ORDER[: 4 + bits.take(4)] if (n := bits.take(3))}
    if not lengths:
        raise Unreadable("a wrong code")
    code = _code(lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    out, s, last = {}, 0, 8
    while s < alphabet and left:
        n, left = bits.symbol(code), left - 1
        if n < 16:
            if n:
                out[s] = last = n
            s += 1
            continue
        again = bits.take((2, 3, 7)[n - 16]) + (3, 3, 11)[n - 16]
        if s + again > alphabet:
            raise Unreadable("a wrong code")
        if n == 16:
            out |= dict.fromkeys(range(s, s + again), last)
        s += again
    if not out:
        raise Unreadable("a wrong code")
    return _code(out)


def _amount(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _blocks(n: int, size: int) -> int:
    return (n + (1 << size) - 1) >> size


def _pixels(bits: _Bits, w: int, h: int, main: bool = False) -> np.ndarray:
    """The stored values of a picture, or of a transform's own small picture."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise Unreadable("a wrong cache")
    groups, size, group_of = 1, 0, None
    if main and bits.take(1):
        size = bits.take(3) + 2
        group_of = (_pixels(bits, _blocks(w, size), _blocks(h, size)) >> 8 & 0xFFFF).tolist()
        groups = max(map(max, group_of)) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    alphabets = (GREEN + len(cache), CHANNEL, CHANNEL, CHANNEL, DISTANCE)
    codes = [[_read_code(bits, a) for a in alphabets] for _ in range(groups)]
    out, total, filed = np.zeros(w * h, np.uint32).tolist(), w * h, 0
    at, shift = 0, 32 - cache_bits
    symbol = bits.symbol
    while at < total:
        y, x = divmod(at, w)
        green, red, blue, alpha, distance = codes[group_of[y >> size][x >> size] if group_of else 0]
        s = symbol(green)
        if s < 256:
            out[at] = s << 8 | symbol(red) << 16 | symbol(blue) | symbol(alpha) << 24
            at += 1
        elif s < GREEN:
            n, d = _amount(bits, s - 256), _amount(bits, symbol(distance))
            if d <= len(NEAR):
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * w)
            else:
                d -= len(NEAR)
            if d > at or at + n > total:
                raise Unreadable("a wrong copy")
            out[at : at + n] = (out[at - d : at] * (n // d + 1))[:n]
            at += n
        else:
            # Values enter the cache late, just before it is read.
            for v in out[filed:at]:
                cache[(v * CACHE_HASH & 0xFFFFFFFF) >> shift] = v
            filed = at
            out[at] = cache[s - GREEN]
            at += 1
    return np.array(out, np.uint32).reshape(h, w)


def _split(p: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue of packed values, as signed numbers."""
    return np.stack([p >> k & 255 for k in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


# Predictions that are one neighbour or the mean of two, of left, up,
# up-left and up-right.
ONE = {1: 0, 2: 1, 3: 3, 4: 2}
TWO = {6: (0, 2), 7: (0, 1), 8: (2, 1), 9: (1, 3)}


def _mean(a: list[int], b: list[int]) -> list[int]:
    return [(i + j) >> 1 for i, j in zip(a, b, strict=True)]


def _guess(mode: int, near: tuple[list[int], ...]) -> list[int]:
    """A pixel's prediction from its neighbours, channel by channel."""
    if mode in ONE:
        return near[ONE[mode]]
    if mode in TWO:
        return _mean(near[TWO[mode][0]], near[TWO[mode][1]])
    left, up, corner, right = near
    if mode == 5:
        return _mean(_mean(left, right), up)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(up, right))
    if mode == 11:
        by_left = sum(abs(b - c) for b, c in zip(up, corner, strict=True))
        by_up = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if by_left < by_up else up
    if mode == 12:
        return [min(max(a + b - c, 0), 255) for a, b, c in zip(left, up, corner, strict=True)]
    if mode == 13:
        return [min(max(m + int((m - c) / 2), 0), 255) for m, c in zip(_mean(left, up), corner, strict=True)]
    return [255, 0, 0, 0]


def _predicted(p: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    h, w = p.shape
    rest, above = _split(p), None
    modes = modes >> 8 & 15
    if (modes == 1).all():
        rest[0, 0, 0] += 255
        rest[:, 0] = np.cumsum(rest[:, 0], axis=0)
        return _joined(np.cumsum(rest, axis=1))
    modes = modes.tolist()
    out = np.zeros_like(rest)
    for y in range(h):
        row: list[list[int]] = []
        for x, r in enumerate(rest[y].tolist()):
            if above is None:
                guess = row[-1] if x else [255, 0, 0, 0]
            elif not x:
                guess = above[0]
            else:
                guess = _guess(modes[y >> size][x >> size], (row[-1], above[x], above[x - 1], above[x + 1] if x + 1 < w else row[0]))
            row.append([(a + b) & 255 for a, b in zip(r, guess, strict=True)])
        out[y], above = row, row
    return _joined(out)


def _recoloured(p: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    h, w = p.shape
    f = _split(factors).astype(np.int8).astype(np.int32)[np.arange(h)[:, None] >> size, np.arange(w)[None] >> size]
    c = _split(p)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    green = signed(c[..., 2])
    c[..., 1] = (c[..., 1] + (f[..., 3] * green >> 5)) & 255
    c[..., 3] += (f[..., 2] * green >> 5) + (f[..., 1] * signed(c[..., 1]) >> 5)
    return _joined(c)


def _greened(p: np.ndarray) -> np.ndarray:
    c = _split(p)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _joined(c)


def _coloured(p: np.ndarray, table: np.ndarray, pack: int, w: int) -> np.ndarray:
    places = p >> 8 & 255
    if pack:
        each = 8 >> pack
        places = (places[..., None] >> (np.arange(1 << pack, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(len(p), -1)[:, :w]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[places]


def _decoded(raw: bytes) -> np.ndarray:
    bits = _Bits(raw)
    if bits.take(8) != 0x2F:
        raise Unreadable("a wrong picture")
    w, h, _, kind = bits.take(14) + 1, bits.take(14) + 1, bits.take(1), bits.take(3)
    if kind:
        raise Unreadable("an unknown WebP kind")
    sized(w, h)
    wide, undo, seen = w, [], set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise Unreadable("a repeated step")
        seen.add(kind)
        if kind < 2:
            size = bits.take(3) + 2
            own = _pixels(bits, _blocks(wide, size), _blocks(h, size))
            step = _recoloured if kind else _predicted
            undo.append(lambda p, own=own, size=size, step=step: step(p, own, size))
        elif kind == 2:
            undo.append(_greened)
        else:
            n = bits.take(8) + 1
            table = _joined(np.cumsum(_split(_pixels(bits, n, 1)[0]), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, table=table, pack=pack, wide=wide: _coloured(p, table, pack, wide))
            wide = _blocks(wide, pack)
    p = _pixels(bits, wide, h, True)
    for step in reversed(undo):
        p = step(p)
    return _split(p)[..., [1, 2, 3, 0]].astype(np.uint8)


def read_webp(raw: bytes) -> np.ndarray:
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise Unreadable("not a WebP")
    at = 12
    while at + 8 <= len(raw):
        kind, size = struct.unpack("<4sI", raw[at : at + 8])
        if kind == b"VP8L":
            return _decoded(raw[at + 8 : at + 8 + size])
        if kind in (b"VP8 ", b"ANIM"):
            raise Unreadable("a lossy WebP" if kind == b"VP8 " else "a moving WebP")
        at += 8 + size + (size & 1)
    raise Unreadable("no picture")


def _written_code(count: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """((value, bits) pairs that state a code, codes and lengths by symbol)."""
    used = np.flatnonzero(count).tolist() or [0]
    codes, sizes = np.zeros(len(count), np.uint64), np.zeros(len(count), np.int64)
    if len(used) <= 2 and used[-1] < 256:
        for i, s in enumerate(used):
            codes[s], sizes[s] = i, len(used) - 1
        return [(1, 1), (len(used) - 1, 1), (1, 1), *((s, 8) for s in used)], codes, sizes
    if len(used) == 1:  # a code of two, as one symbol beyond 255 can't be stated alone
        used = [0, *used]
    lengths = code_lengths(Counter({s: max(1, int(count[s])) for s in used}), 15, False)
    for s, (code, n) in _numbered(lengths).items():
        codes[s], sizes[s] = int(f"{code:0{n}b}"[::-1], 2), n
    each = Counter(sizes.tolist())
    own = code_lengths(each, 7, False) if len(each) > 1 else {next(iter(each)): 1}
    stated = [(0, 1), (len(LENGTH_ORDER) - 4, 4), *((own.get(s, 0), 3) for s in LENGTH_ORDER), (0, 1)]
    by = _numbered(own)
    if len(own) > 1:
        stated += [(int(f"{by[n][0]:0{by[n][1]}b}"[::-1], 2), by[n][1]) for n in sizes.tolist()]
    return stated, codes, sizes


def _packed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits of all values, lowest first."""
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return (np.repeat(values, sizes) >> place.astype(np.uint64) & np.uint64(1)).astype(np.uint8)


def write_webp(p: np.ndarray) -> bytes:
    """A lossless file: red and blue less green, each pixel less its left one."""
    h, w = p.shape[:2]
    if max(h, w) > 1 << 14:
        raise Unreadable(f"a picture of {w} x {h}")
    c = p[..., [3, 0, 1, 2]]  # numbers of eight bits, which wrap as they should
    c[..., 1] -= c[..., 2]
    c[..., 3] -= c[..., 2]
    rest = c.copy()
    rest[:, 1:] -= c[:, :-1]
    rest[1:, 0] -= c[:-1, 0]
    rest[:1, 0, 0] -= np.uint8(255)
    rest = rest.reshape(-1, 4)
    stated = [(0x2F, 8), (w - 1, 14), (h - 1, 14), (int((p[..., 3] < 255).any()), 1), (0, 3)]
    stated += [(1, 1), (2, 2), (1, 1), (0, 2), (7, 3), (0, 1)]
    one = lambda n, s: _written_code(np.bincount([s], minlength=n))[0]
    stated += [*one(GREEN, 1), *one(CHANNEL, 0), *one(CHANNEL, 0), *one(CHANNEL, 0), *one(DISTANCE, 0)]
    # Undone last to first: the pixels' differences, then green; no cache, one group.
    stated += [(0, 1), (0, 1), (0, 1)]
    order, tables = (2, 1, 3, 0), []
    for channel, n in zip(order, (GREEN, CHANNEL, CHANNEL, CHANNEL), strict=True):
        said, code, size = _written_code(np.bincount(rest[:, channel], minlength=n))
        stated += said
        tables.append((code, size))
    stated += one(DISTANCE, 0)
    held = _packed(np.array([v for v, _ in stated], np.uint64), np.array([n for _, n in stated]))
    data = bytearray()
    for i in range(0, len(rest), 1 << 16):
        some = rest[i : i + (1 << 16)]
        code, size = (np.stack([t[k][some[:, j]] for j, t in zip(order, tables, strict=True)], axis=1).ravel() for k in (0, 1))
        held = np.concatenate([held, _packed(code, size)])
        whole = len(held) // 8 * 8
        data += np.packbits(held[:whole], bitorder="little").tobytes()
        held = held[whole:]
    data += np.packbits(held, bitorder="little").tobytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + bytes(data) + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body
