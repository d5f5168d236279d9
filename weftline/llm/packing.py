"""Token ids in fixed-width bit-packed shards.

A shard is one byte string:

    magic "WFT1" | bits u32 | block u32 | n_docs u32 | n_ids u64 | n_blocks u64
    doc_ids i64[n_docs] | doc_ends u64[n_docs] | block_offsets u64[n_blocks + 1]
    payload

Each id takes the fewest bits that hold the vocabulary's largest id, the lowest
bit first; every ``block`` ids start on a byte of their own, at the payload's
block_offsets[i].  Any run of ids is so read from the blocks it touches, unpacked
by numpy at once.  Shards are rows of a Parquet table that Spark writes and
commits: they go to any store, and a lost executor leaves no half file.  A row also
names its shard's first and last doc_id, so that Parquet's own statistics find the
shards of some documents without reading the others.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Remembered, Splitter
from .common import bound_batches, id_and_text, per_worker

MAGIC, HEAD = b"WFT1", "<4sIIIQQ"
BLOCK = 4096
#: A shard is closed once it holds so many ids.
SHARD_IDS = 1 << 18
NO_ID = -(2**63)
#: Pre-tokens that a worker remembers, some 150 bytes each: more than for bpe, as the
#: library is slower on those it is asked for again.
REMEMBERED = 800_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id of {int(ids.max())} doesn't fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    names = np.array([NO_ID if i is None else i for i in doc_ids], np.int64)
    ends = np.cumsum([len(d) for d in docs], dtype=np.uint64)
    head = struct.pack(HEAD, MAGIC, bits, block, len(docs), len(ids), len(blocks))
    return b"".join([head, names.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to a shard's ids: ``ids(i, j)``, ``doc(k)``."""

    def __init__(self, raw: bytes):
        magic, self.bits, self.block, self.n_docs, self.n_ids, self.n_blocks = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(raw, np.int64, self.n_docs, at)
        self.ends = np.frombuffer(raw, np.uint64, self.n_docs, at + 8 * self.n_docs).astype(np.int64)
        at += 16 * self.n_docs
        self.offsets = np.frombuffer(raw, np.uint64, self.n_blocks + 1, at).astype(np.int64)
        self.payload = memoryview(raw)[at + 8 * (self.n_blocks + 1) :]

    def ids(self, i: int, j: int) -> np.ndarray:
        if i >= j:
            return np.empty(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        got = [
            unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block))
            for k in range(first, last + 1)
        ]
        return np.concatenate(got)[i - first * self.block : j - first * self.block]

    def start(self, k: int) -> int:
        return int(self.ends[k - 1]) if k else 0

    def doc(self, k: int) -> np.ndarray:
        return self.ids(self.start(k), int(self.ends[k]))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: its own where
    Latin-1 shows one, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class JsonTokenizer:
    """encode(text) -> ids of a tokenizers file, as bytes; the file's own
    splitting pattern makes each pre-token independent, so they're remembered.
    Texts that hold a special token's string go to the library whole."""

    #: The fixed splitting pattern of byte-level pre-tokenisation.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.alone = bool(plain) and not spec.get("normalizer") and not spec.get("post_processor")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split, self.known = Splitter(self.PATTERN), Remembered(self._piece, REMEMBERED)
        self.merged, self.mapped = self.lib.model.tokenize, byte_letters()

    def _one(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """One pre-token's ids from the model itself, which takes bytes as letters."""
        letters = piece.encode().decode("latin-1").translate(self.mapped)
        return array("I", [t.id for t in self.merged(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.alone or any(s in text for s in self.special):
            return self._one(text)
        return self.known.join(self.split(text))


def write(docs: DataFrame, path: str, encoder: Callable[[], Callable[[str], bytes]], vocabulary: int, end: int | None) -> None:
    """Encode every whole text and write the shards in ascending doc_id order.

    docs: (_id, _t).  The texts are dealt by ranges of doc_id and sorted, so that
    shards are runs of the corpus; a task holds one open shard at a time.  Rows
    that repeat a doc_id follow one another, and null doc_ids come first."""
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        tail = b"" if end is None else struct.pack("<I", end)

        def close() -> pa.RecordBatch:
            known = [x for x in names if x is not None]
            row = [[part], [seq], [len(names)], [size], known[:1] or [None], known[-1:] or [None], [build(names, held, bits)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)],
                ["part", "seq", "n_docs", "n_ids", "first_doc", "last_doc", "shard"],
            )

        for batch in batches:
            for i, t in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                ids = np.frombuffer(encode(t or "") + tail, "<u4")
                names.append(i)
                held.append(ids)
                size += len(ids)
                if size >= SHARD_IDS:
                    yield close()
                    names, held, size, seq = [], [], 0, seq + 1
        if names:
            yield close()

    # The text's hash splits what repeats one doc_id or has none.
    order = ["_id", F.xxhash64("_t")]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, first_doc long, last_doc long, shard binary").write.parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """(part, seq, start): the ids before each shard, as sums within a part and
    over the parts, whose number doesn't depend on the rows of a part."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part")
    return sizes.select("part", "seq", (F.col("before") + F.col("inside")).alias("begin"))


def documents_of(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards.

    Only a row of a few numbers a document meets the shards' starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, raw = (batch.column(k)[i].as_py() for k in ("part", "seq", "shard"))
                s = Shard(raw)
                ids = s.ids(0, s.n_ids).astype("<u4")
                begins = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                n = len(begins)
                cols = [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, seq, np.int32)),
                    pa.array([None if x == NO_ID else x for x in s.doc_ids.tolist()], pa.int64()),
                    pa.array(begins),
                    pa.array(s.ends - begins),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, s.ends, strict=True)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "own", "n_tokens", "ids_crc32"])

    few = shards.select("part", "seq", "shard")
    rows = few.mapInArrow(run, "part int, seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    rows = rows.join(starts(shards), ["part", "seq"])
    return rows.select("doc_id", (F.col("begin") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def documents(shards: DataFrame, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, ids array<int>) of some documents, given by the driver: only the shards
    whose first and last doc_id enclose one are read, and only its blocks unpacked."""
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("shard"):
                s = Shard(raw.as_py())
                at = np.flatnonzero(np.isin(s.doc_ids, np.array(wanted, np.int64)))
                ids = pa.array([s.doc(int(k)).view(np.int32) for k in at], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[at]), ids], ["doc_id", "ids"])

    among = F.array(*[F.lit(i).cast("long") for i in wanted]).cast("array<bigint>")
    near = shards.where((F.col("last_doc") >= (wanted or [0])[0]) & (F.col("first_doc") <= (wanted or [0])[-1]))  # pushed to the scan
    near = near.where(F.exists(among, lambda i: (i >= F.col("first_doc")) & (i <= F.col("last_doc"))))
    return near.select("shard").mapInArrow(run, "doc_id long, ids array<int>")


def vocabulary_of(tokenizer: str) -> int:
    """One more than the largest id of a tokenizers file."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def write_and_read(
    docs: DataFrame, tokenizer: str, path: str, vocabulary: int | None = None, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the documents' ids to ``path`` and return, from the files,
    (doc_id, start, n_tokens, ids_crc32).  ``vocabulary`` is the tokenizer's own where
    it isn't given.

    Null and empty texts hold the end id alone; repeated rows are written each;
    null doc_ids come first; further columns are ignored; an empty table writes
    no shard and gives an empty result."""
    bound_batches(docs.sparkSession)

    def encoder() -> Callable[[str], bytes]:
        return per_worker(("json", tokenizer), lambda: JsonTokenizer(tokenizer)).encode

    write(id_and_text(docs, id_col, text_col), path, encoder, vocabulary or vocabulary_of(tokenizer), end)
    return documents_of(docs.sparkSession.read.parquet(path))
