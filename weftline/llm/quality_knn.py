"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its hashed words, hashed n-grams of its shape (the sequence of
character classes with runs made one) and how many of its words and lines repeat.
Weighted by tf-idf, each family to a length of its own, and projected on the leading
singular vectors of the labelled texts, they give a vector; every document's exact
cosine with every labelled vector comes from blocked matrix products, and its nearest
neighbours vote by similarity.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out, id_and_text, labelled_sample, map_text, per_worker

ORDERS, DIMS, NEIGHBOURS, BLOCK = (1, 2, 3, 4), 64, 15, 256
#: Slots of the shapes' n-grams, of words, and of repeated words and lines.
SHAPES, WORDS, REPEATS = 1 << 11, 1 << 12, 2
TERMS = SHAPES + WORDS + REPEATS
#: Lengths of the three families in a text's vector before projection.
WEIGHTS = (1.0, 0.6, 0.5)
#: Labelled rows that are learnt from at most (those with the smallest hash of
#: doc_id, of texts of at most LEARN_CHARS characters): the bound of the broadcast.
SAMPLE, LEARN_CHARS = 4000, 50_000
#: Cosines are equal if they are to so many parts; equal ones go by doc_id.
EXACT = 1 << 40
_M = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def _classes() -> np.ndarray:
    """The class of each code point of the first plane; others are themselves."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        table[i] = ord("a") if c.islower() else ord("A") if c.isupper() else ord("0") if c.isdecimal() else 32 if c in " \t\r" else i
    return table


def shape(text: str) -> np.ndarray:
    """Code points with letters as A or a, digits as 0 and white space as a space
    or line feed; equal neighbours are made one."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(p):
        return p
    s = per_worker(("classes",), _classes).take(p, mode="clip")
    if p.max() > 0xFFFF:
        s = np.where(p > 0xFFFF, p, s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, dampened counts relative to the text's length)."""
    s, found = shape(text), []
    for n in ORDERS:
        k = len(s) - n + 1
        if k > 0:
            h = s[:k] * _M[0] + np.uint32(n)
            for i in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _M[i] + s[i : i + k]
            found.append(((h ^ (h >> np.uint32(16))) * _M[3] >> np.uint32(21)).astype(np.int64))
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    count = np.zeros(TERMS)
    if found:
        count[:SHAPES] = np.bincount(np.concatenate(found), minlength=SHAPES)
    each = Counter(text.lower().split())
    np.add.at(count, [SHAPES + (xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) & (WORDS - 1)) for w in each], list(each.values()))
    count[-2:] = sum(map(str.__eq__, words, words[1:])), len(lines) - len(set(lines))
    at = np.flatnonzero(count)
    return at, np.log1p(1000.0 * count[at] / max(1, len(words)))


class Voters:
    """idf and projection of the labelled texts, their vectors and labels, by doc_id."""

    def __init__(self, rows: list[tuple[int, str, int]], rounds: int = 8):
        rows = sorted(rows)
        self.labels = np.array([y for *_, y in rows], np.float64)
        found = [terms(t) for _, t, _ in rows]
        n = len(rows)
        df = np.bincount(np.concatenate([a for a, _ in found]) if found else np.empty(0, np.int64), minlength=TERMS)
        self.idf = np.where(df > 1, np.log((n + 1) / (df + 1)) + 0.1, 0.0)
        self.project = np.eye(TERMS, DIMS, dtype=np.float64)
        # The leading singular vectors by subspace iteration over blocks of rows: no
        # matrix of all rows or of all pairs of terms is held.
        q = np.linalg.qr(np.random.default_rng(5).standard_normal((TERMS, DIMS + 16)))[0]
        for _ in range(rounds if n else 0):
            product = np.zeros_like(q)
            for i in range(0, n, BLOCK):
                x = np.zeros((min(BLOCK, n - i), TERMS))
                for r, (a, v) in enumerate(found[i : i + BLOCK]):
                    x[r, a] = self._weighted(a, v)
                product += x.T @ (x @ q)
            q = np.linalg.svd(product, full_matrices=False)[0]
        if n:
            self.project = np.ascontiguousarray(q[:, :DIMS])
        self.vectors = np.array([self.vector(*f) for f in found], np.float64).reshape(-1, DIMS)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / (np.linalg.norm(v) or 1.0)

    def _weighted(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """tf-idf, each family of terms to its own length."""
        out = value * self.idf[at]
        for first, last, weight in ((0, SHAPES, WEIGHTS[0]), (SHAPES, SHAPES + WORDS, WEIGHTS[1]), (SHAPES + WORDS, TERMS, WEIGHTS[2])):
            own = (at >= first) & (at < last)
            out[own] = weight * self._unit(out[own]) if last < TERMS else weight * np.tanh(out[own] / 10)
        return out

    def vector(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self._unit(self._weighted(at, value) @ self.project[at])

    def scores(self, texts: list[str]) -> list[float]:
        """Similarity-weighted share of label 1 among each text's neighbours; of equal
        cosines the smaller doc_id is nearer."""
        n = len(self.labels)
        if not n:
            return [0.5] * len(texts)
        out: list[float] = []
        k = min(NEIGHBOURS, n)
        for i in range(0, len(texts), BLOCK):
            x = np.array([self.vector(*terms(t)) for t in texts[i : i + BLOCK]])
            cos = np.rint(x @ self.vectors.T * EXACT).astype(np.int64)
            near = np.argpartition(np.arange(n) - cos * n, k - 1, axis=1)[:, :k]  # no two are equal
            weight = np.clip(np.take_along_axis(cos, near, 1) / EXACT, 0.0, None) ** 8 + 1e-6
            out += ((weight * self.labels[near]).sum(1) / weight.sum(1)).tolist()
        return out


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    learn_chars: int = LEARN_CHARS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    At most ``sample`` labelled rows that aren't held out, of texts of at most
    ``learn_chars`` characters, vote; their vectors, sample x DIMS numbers, and the
    projection, TERMS x DIMS, are what is broadcast.  What that leaves out of
    learning is scored like the rest.  Of equally near voters the one with the
    smaller doc_id counts.  Null and empty texts have a vector of zeros, which all
    voters are equally far from; without labels every score is 0.5; null labels
    don't vote.  Repeated rows get equal results, null doc_ids pass and are never
    held out, further columns are ignored, an empty table gives an empty result."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = id_and_text(docs, id_col, text_col)
    state = spark.sparkContext.broadcast(vars(Voters(labelled_sample(docs, labels, id_col, label_col, sample, learn_chars))))

    def run(texts: list[str]) -> dict[str, list]:
        voters = Voters.__new__(Voters)
        vars(voters).update(state.value)
        return {"score": voters.scores(texts)}

    out = map_text(docs, run, "score double", ["_id"])
    return out.select(
        F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
