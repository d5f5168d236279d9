"""Archives: entries of zip and tar files and back."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from dataclasses import dataclass

from . import Unreadable

# Limits of unpacking, and the time that packed members carry.
MAX_UNPACKED, MAX_ENTRIES, EPOCH = 128 << 20, 100_000, (1980, 1, 1, 0, 0, 0)


@dataclass
class Entry:
    name: str
    data: bytes
    is_dir: bool = False
    mode: int = 0o644


def clean_name(name: str, is_dir: bool = False) -> str | None:
    """The name made relative; None where it would leave the folder."""
    parts = name.replace("\\", "/").lstrip("/").split("/")
    kept = [p for p in parts if p not in ("", ".")]
    if ".." in parts or not kept:
        return None
    return "/".join(kept) + ("/" if is_dir else "")


def _bounded(stream, left: int) -> bytes:
    data = stream.read(left + 1)
    if len(data) > left:
        raise Unreadable("more than the unpacked limit")
    return data


def _plain_tar(raw: bytes, kind: str) -> bytes:
    """The tar inside, read no further than the limit."""
    most = MAX_UNPACKED + (MAX_ENTRIES * 1024)
    if kind == "tar":
        return raw
    if kind == "tzst":
        import zstandard

        try:
            return _bounded(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)), most)
        except zstandard.ZstdError as e:
            raise Unreadable(str(e)) from None
    opener = {"tgz": gzip.open, "tbz2": bz2.open, "txz": lzma.open}[kind]
    return _bounded(opener(io.BytesIO(raw)), most)


def read(raw: bytes, kind: str) -> list[Entry]:
    """The archive's files and folders; links and other special entries, and names
    that would leave the folder, are left out."""
    out: list[Entry] = []
    left = MAX_UNPACKED
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for i in z.infolist():
                    special = i.external_attr >> 28 not in (0, 4, 8)
                    name = clean_name(i.filename, i.is_dir())
                    if name and not special:
                        with z.open(i) as f:
                            data = b"" if i.is_dir() else _bounded(f, left)
                        left -= len(data)
                        out.append(Entry(name, data, i.is_dir(), (i.external_attr >> 16) & 0o777 or 0o644))
                    if len(out) > MAX_ENTRIES:
                        raise Unreadable("too many entries")
        elif kind == "rar":
            raise Unreadable("no reader for this archive")
        else:
            with tarfile.open(fileobj=io.BytesIO(_plain_tar(raw, kind)), mode="r:") as t:
                for m in t:
                    name = clean_name(m.name, m.isdir())
                    if name and (m.isfile() or m.isdir()):
                        data = _bounded(t.extractfile(m), left) if m.isfile() else b""
                        left -= len(data)
                        out.append(Entry(name, data, m.isdir(), m.mode))
                    if len(out) > MAX_ENTRIES:
                        raise Unreadable("too many entries")
    except (OSError, EOFError, RuntimeError, ValueError, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable(str(e)) from None
    return out


def write(entries: list[Entry], kind: str) -> bytes:
    """An archive with fixed times, so equal entries give equal bytes."""
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for e in entries:
                i = zipfile.ZipInfo(e.name, EPOCH)
                i.external_attr = (0o40755 << 16 | 16) if e.is_dir else (0o100000 | e.mode) << 16
                i.compress_type = zipfile.ZIP_STORED if e.is_dir else zipfile.ZIP_DEFLATED
                z.writestr(i, e.data)
        return out.getvalue()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for e in entries:
            i = tarfile.TarInfo(e.name.rstrip("/"))
            i.type, i.mode, i.size = (tarfile.DIRTYPE, 0o755, 0) if e.is_dir else (tarfile.REGTYPE, e.mode, len(e.data))
            t.addfile(i, io.BytesIO(e.data))
    raw = out.getvalue()
    if kind == "tgz":
        return gzip.compress(raw, 9, mtime=0)
    if kind == "txz":
        return lzma.compress(raw)
    if kind == "tzst":
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(raw)
    return raw


def unique_names(names: list[str]) -> list[str]:
    """File names of a packing: -2, -3, ... before the extension for repeated ones."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = n.replace("\\", "/").rpartition("/")[2]
        base = "file" if base in ("", ".") else base
        seen[base] = k = seen.get(base, 0) + 1
        stem, dot, ext = base.rpartition(".")
        out.append(base if k == 1 else f"{stem}-{k}.{ext}" if dot else f"{base}-{k}")
    return out


def pack_one(raw: bytes, name: str, kind: str) -> bytes:
    return write([Entry(unique_names([name])[0], raw)], kind)
