"""Font files as tables: TrueType, OpenType and WOFF."""

from __future__ import annotations

import struct
import zlib

from . import Unreadable

SFNT = (b"\0\1\0\0", b"OTTO", b"true", b"typ1")
MAX_TABLES = 512


def read_sfnt(raw: bytes) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """(flavour, [(tag, data)])."""
    if len(raw) < 12 or raw[:4] not in SFNT:
        raise Unreadable("not a font")
    n = struct.unpack(">H", raw[4:6])[0]
    if not 0 < n <= MAX_TABLES or len(raw) < 12 + 16 * n:
        raise Unreadable("a wrong number of tables")
    out = []
    for i in range(n):
        tag, _, at, size = struct.unpack(">4sIII", raw[12 + 16 * i : 28 + 16 * i])
        if at + size > len(raw):
            raise Unreadable("a table outside the file")
        out.append((tag, raw[at : at + size]))
    return raw[:4], out


def checksum(data: bytes) -> int:
    padded = data + b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF


def write_sfnt(flavour: bytes, tables: list[tuple[bytes, bytes]]) -> bytes:
    n = len(tables)
    power = n.bit_length() - 1
    head = flavour + struct.pack(">HHHH", n, 16 << power, power, 16 * n - (16 << power))
    at, body, index = 12 + 16 * n, b"", b""
    for tag, data in tables:
        index += struct.pack(">4sIII", tag, checksum(data), at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return head + index + body


def to_woff(raw: bytes) -> bytes:
    """Tables compressed where that makes them smaller."""
    flavour, tables = read_sfnt(raw)
    at, body, index = 44 + 20 * len(tables), b"", b""
    for tag, data in sorted(tables):
        packed = zlib.compress(data, 9)
        packed = packed if len(packed) < len(data) else data
        index += struct.pack(">4sIIII", tag, at + len(body), len(packed), len(data), checksum(data))
        body += packed + b"\0" * (-len(packed) % 4)
    whole = 12 + 16 * len(tables) + sum(len(d) + -len(d) % 4 for _, d in tables)
    return struct.pack(">4s4sIHHIHHIIIII", b"wOFF", flavour, at + len(body), len(tables), 0, whole, 1, 0, 0, 0, 0, 0, 0) + index + body


def from_woff(raw: bytes) -> bytes:
    if raw[:4] == b"wOF2":
        raise Unreadable("WOFF2 isn't read")
    if raw[:4] != b"wOFF" or len(raw) < 44:
        raise Unreadable("not a WOFF font")
    n = struct.unpack(">H", raw[12:14])[0]
    if not 0 < n <= MAX_TABLES or len(raw) < 44 + 20 * n:
        raise Unreadable("a wrong number of tables")
    tables = []
    for i in range(n):
        tag, at, packed, size, _ = struct.unpack(">4sIIII", raw[44 + 20 * i : 64 + 20 * i])
        data = raw[at : at + packed]
        try:
            data = zlib.decompressobj().decompress(data, size) if packed < size else data
        except zlib.error as e:
            raise Unreadable(str(e)) from None
        if len(data) != size:
            raise Unreadable("a short table")
        tables.append((tag, data))
    return write_sfnt(raw[4:8], tables)


def relabel(raw: bytes) -> bytes:
    """A TrueType file is an OpenType file as it is."""
    read_sfnt(raw)
    return raw
