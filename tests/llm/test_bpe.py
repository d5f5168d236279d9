import hashlib

import numpy as np
import pytest

from weftline.llm import bpe as B
from weftline.llm import packing as K
from weftline.llm.queries import splitting_pattern, tokenizer_file

TEXTS = ["", " ", "\n\n \n x", "Hello, world's  best!!", "naïve café 12345 ½²", "日本語のテキスト", "👩‍👩‍👧 emoji ​", "a" * 3000, "don't we'll I'M", "<|endoftext|> here", "\x00\x1c\x85\xa0", "ÿþ ﻿", "tab\tand\r\nline"]


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("byte_bpe_multi_50k.tiktoken")


def reference(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=splitting_pattern(), mergeable_ranks=B.read_ranks(path), special_tokens={})


def test_as_the_library(path):
    own, ref = B.ByteBpe(path, splitting_pattern()), reference(path)
    more = ["".join(chr(c) + " a" for c in range(lo, lo + 40)) for lo in range(0x80, 0xD000, 997)]
    more += ["".join(chr(c) + " a" for c in range(lo, lo + 40)) for lo in range(0x10000, 0x110000 - 40, 9973)]
    for t in TEXTS + more:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_forgetting_changes_nothing():
    r = B.Remembered(lambda x: x.encode() * 2, most=6)
    for _ in range(3):
        for k in "abcdefghij":
            assert r.join([k, k]) == k.encode() * 4
        assert len(r) + len(r.old) <= 7


def test_ranks_must_be_whole(path):
    ranks = B.read_ranks(path)
    for bad in ({k: v + 1 for k, v in ranks.items()}, {k: i for i, k in enumerate(k for k in ranks if k != b"\x00")}):
        with pytest.raises(ValueError):
            B.model_proto(bad)


def test_round_trip(docs_of, clashing, odd_rows, path):
    ref = reference(path)
    rows = list(enumerate(TEXTS))
    got = B.round_trip(docs_of(rows), path, splitting_pattern(), with_ids=True).collect()
    for r in got:
        ids = ref.encode_ordinary(TEXTS[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest()
    enc = B.encode(docs_of(rows), path, splitting_pattern())
    assert {r.doc_id: bytes(r.bytes) for r in B.decode(enc, path, splitting_pattern()).collect()} == {i: t.encode() for i, t in rows}
    assert B.round_trip(clashing, path, splitting_pattern()).count() == len(odd_rows)
    assert B.round_trip(docs_of([]), path, splitting_pattern()).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5000, 17, 4096, 0)]
    s = K.Shard(K.build([None, *range(5)], docs, bits, block=64))
    assert s.doc_ids.tolist() == [K.NO_ID, 0, 1, 2, 3, 4]
    for k, d in enumerate(docs):
        assert np.array_equal(s.doc(k), d)
    flat = np.concatenate(docs)
    for _ in range(50):
        i, j = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert np.array_equal(s.ids(i, j), flat[i:j])
    with pytest.raises(ValueError):
        K.pack(np.array([2**bits - 1, 1 << min(bits, 31)], np.uint32) if bits < 32 else np.array([1 << 40], np.uint64), bits)


def test_bits():
    assert [K.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_written_files(spark, docs_of, clashing, odd_rows, tmp_path, monkeypatch):
    import zlib

    from tokenizers import Tokenizer

    monkeypatch.setattr(K, "SHARD_IDS", 50)
    file = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(file)
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)]) for i in range(101)]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in K.write_and_read(docs_of(rows), file, str(tmp_path / "a"), 50_257).collect()}
    at = 0
    for i, t in sorted(rows):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    odd = K.write_and_read(clashing, file, str(tmp_path / "b"), 50_257).orderBy("start").collect()
    assert [r.doc_id for r in odd] == sorted((r[0] for r in odd_rows), key=lambda x: -1 if x is None else x)
    assert [r.n_tokens for r in odd][1:3] == [1, 1]
    assert K.write_and_read(docs_of([]), file, str(tmp_path / "c"), 50_257).count() == 0


def test_documents_are_found_by_their_shard(spark, docs_of, tmp_path, monkeypatch):
    from weftline.llm import packing as P
    from weftline.llm.queries import tokenizer_file

    monkeypatch.setattr(P, "SHARD_IDS", 200)
    path, file = f"file://{tmp_path}/shards", tokenizer_file("byte_bpe_50k.json")
    rows = [(i, f"text number {i} " * (i % 5 + 1)) for i in range(0, 400, 2)] + [(None, "no id"), (7, "twice"), (7, "twice or so")]
    P.write_and_read(docs_of(rows), file, path).count()
    shards = spark.read.parquet(path)
    assert shards.count() > 5 and P.vocabulary_of(file) == 50_257
    got = P.documents(shards, [4, 7, 398, 5, 10**9]).collect()
    t = P.JsonTokenizer(file)
    want = sorted((i, np.frombuffer(t.encode(x), "<u4").tolist() + [2]) for i, x in rows if i in (4, 7, 398))
    assert sorted((r.doc_id, r.ids) for r in got) == want
    plan = P.documents(shards, [4])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last_doc,4)" in plan and P.documents(shards, []).count() == 0


@pytest.mark.parametrize("vocabulary", [2, 300, 50_257, 70_000, 1 << 17])
def test_query_widths_round_trip(docs_of, tmp_path, vocabulary):
    """The bit path through files, at widths other than whole bytes too."""
    from weftline.llm import packing as P

    path, ids = f"file://{tmp_path}/v{vocabulary}", np.random.default_rng(vocabulary)
    encode = lambda t: (np.array([ord(c) * 977 for c in t], np.uint64) % vocabulary).astype("<u4").tobytes()
    docs = docs_of([(i, "".join(chr(97 + int(x)) for x in ids.integers(0, 26, 50 * i))) for i in range(40)])
    P.write(docs.selectExpr("doc_id as _id", "text as _t"), path, lambda: encode, vocabulary, None)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in P.documents_of(docs.sparkSession.read.parquet(path)).collect()}
    import zlib

    assert got == {r.doc_id: (len(r.text), zlib.crc32(encode(r.text))) for r in docs.collect()}
