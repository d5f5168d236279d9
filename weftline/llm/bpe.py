"""Byte-level BPE through a sentencepiece model written straight from the ranks.

A vocabulary of byte strings with ranks becomes a sentencepiece BPE model: each
byte is one character (U+0100 plus the byte, so none is white space or a meta
symbol), each piece is scored by its negative rank, and normalisation is the
identity.  Sentencepiece then merges, as rank files ask for, the adjacent pair of
the lowest rank, the leftmost first.  A pre-token that is itself in the vocabulary
is its own id.  Decoding maps ids back to their byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, map_text, per_worker

#: Pre-tokens that a worker remembers, some 150 bytes each.
REMEMBERED = 200_000
# Characters for which the standard library's regular expressions, which are faster, agree with any Unicode version.
PLAIN_LETTERS, NOT_PLAIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"[^\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]"


class Remembered(dict):
    """pre-token -> make(pre-token), for short ones; beyond ``most`` of them the
    older half goes, except what is asked for again."""

    LONGEST = 64

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def join(self, keys: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, keys))


class Splitter:
    """The matches of a splitting pattern, with letters and digits as the
    tokenizer libraries' Unicode version has them; what only the regex module
    knows stands as an unassigned character while a text is split."""

    def __init__(self, pattern: str):
        import unicodedata

        import regex
        from tokenizers import Regex, pre_tokenizers

        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        doubtful = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN")
        ask = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")
        later = "".join(piece for piece, _ in ask.pre_tokenize_str(doubtful)) if doubtful else ""
        plain = pattern.replace(r"\s\p{L}\p{N}", rf"\s{PLAIN_LETTERS}0-9").replace(r"\p{L}", f"[{PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]")
        self.plain = None if r"\p" in plain else re.compile(plain).findall
        self.beyond = re.compile(NOT_PLAIN).search
        self.first = min(later, default=None)
        self.stand_in = dict.fromkeys(map(ord, later), "\u0378")

    def __call__(self, text: str) -> list[str]:
        if self.plain and not self.beyond(text):
            return self.plain(text)
        if not self.first or max(text) < self.first or self.stand_in.keys().isdisjoint(map(ord, set(text))):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


_UP = {i: i + 256 for i in range(256)}


def as_chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_UP)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model.  Ranks must be 0, 1, 2, ...: the id of
    a piece is then its rank, and the unknown piece, never used, comes last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be consecutive from 0")
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"single bytes without rank: {missing}")
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, as_chars(t).encode()) + _field(2, float(-r)) + _field(3, normal)) for r, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(out)) + _field(40, len(tokens)) + b"".join(_field(i, -1) for i in (41, 42, 43))
    plain = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, plain)


class ByteBpe:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit bytes,
    ``decode`` the text's bytes."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.split = Splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.known = Remembered(self._one)

    def _one(self, pretoken: str) -> bytes:
        raw = pretoken.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        return np.array(self.model.encode(as_chars(raw)) if rank is None else [rank], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.known.join(self.split(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _bpe(path: str, pattern: str) -> ByteBpe:
    return per_worker(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have no ids.

    Rows map one to one, without a shuffle; repeated rows and null doc_ids pass,
    further columns are ignored, an empty table gives an empty result."""

    def run(texts: list[str]) -> dict[str, Iterable]:
        b = _bpe(path, pattern)
        return {"ids": [np.frombuffer(b.encode(t), "<i4") for t in texts]}

    bound_batches(docs.sparkSession)
    return map_text(id_and_text(docs, id_col, text_col), run, "ids array<int>", ["_id"]).withColumnRenamed("_id", "doc_id")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids): the inverse mapping; null ids give none."""
    import pyarrow as pa

    def run(batches):
        b = _bpe(path, pattern)
        for batch in batches:
            made = [b.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "bytes"])

    bound_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding, then decoding
    of the ids, digested where they are made so that neither is shuffled; also ids
    (array<int>) if ``with_ids``; the columns in ``keep`` pass through.  Cases as for
    ``encode``."""

    def run(texts: list[str]) -> dict[str, list]:
        b = _bpe(path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for t in texts:
            ids = b.encode(t)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(np.frombuffer(ids, "<i4"))
        return out

    bound_batches(docs.sparkSession)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), *keep)
    return map_text(own, run, schema, ["_id", *keep]).withColumnRenamed("_id", "doc_id")
