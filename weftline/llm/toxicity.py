"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are presences of hashed character 3- to 5-grams of the lower-cased text.
Each is scaled by its naive Bayes log-count ratio between the classes, and a
logistic regression with an L2 penalty learns weights on the scaled features.  A
score is then one table lookup per n-gram position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out, id_and_text, labelled_sample, map_text, texts_of

ORDERS, BITS = (3, 4, 5), 20
#: Labelled rows that are learnt from at most: those with the smallest hash of
#: doc_id, of texts of at most LEARN_CHARS characters.  Scores use whole texts.
SAMPLE, LEARN_CHARS = 5000, 5000
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, white space as one space."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(p: np.ndarray, n: int) -> np.ndarray:
    """A feature number for every n-gram position."""
    k = len(p) - n + 1
    if k <= 0:
        return np.empty(0, np.int64)
    h = p[:k] * _M[0]
    for i in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _M[i % 5] + p[i : i + k] * _M[(i + n) % 5]
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x5BD1E995)
    return ((h >> np.uint32(32 - BITS)) ^ np.uint32(n)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text."""
    p = points(text)
    return np.unique(np.concatenate([hashed(p, n) for n in ORDERS])).astype(np.int32)


def _sums(at: np.ndarray, size: int, weight: tuple[np.ndarray, np.ndarray] | None = None, step: int = 1 << 20) -> np.ndarray:
    """bincount in steps, which convert little at a time; a weight is (table, index)."""
    out = np.zeros(size)
    for i in range(0, len(at), step):
        j = slice(i, i + step)
        out += np.bincount(at[j], None if weight is None else weight[0][weight[1][j]], size)
    return out


def fit(texts: list[tuple[str, int]], rounds: int = 60, penalty: float = 2.0, alpha: float = 1.0) -> dict:
    """The table of weight times ratio by feature, and the bias.

    The penalty and the rounds were chosen over three folds of labelled rows that
    aren't held out: a smaller penalty takes more clean texts for toxic ones.
    With one class only, or no row, the score is that class's share everywhere."""
    y = np.array([label for _, label in texts], np.float64)
    table = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return {"table": table, "bias": float(np.log(share / (1 - share)))}
    found = [features(t) for t, _ in texts]
    at = np.repeat(np.arange(len(found), dtype=np.int32), list(map(len, found)))
    of = np.concatenate(found)
    del found
    every = _sums(of, 1 << BITS)
    toxic = _sums(of, 1 << BITS, (y, at))
    ratio = np.log((toxic + alpha) / (y.sum() + 2 * alpha)) - np.log((every - toxic + alpha) / ((1 - y).sum() + 2 * alpha))
    strong = (every >= 3) & (np.abs(ratio) > 0.05)
    use = strong[of]
    of, at = of[use], at[use]
    kept = np.flatnonzero(strong)
    place = np.zeros(1 << BITS, np.int32)
    place[kept] = np.arange(len(kept))
    local, r = place[of], ratio[kept]
    w, b = np.ones_like(r) * 0.01, 0.0
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = _sums(at, len(y), (w * r, local)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = (p - y) * np.where(y > 0, 1.5, 1.0) / len(y)
        g_w = _sums(local, len(w), (g, at)) * r + penalty * w / len(y)
        g_b = g.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.99 * v_w + 0.01 * g_w**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.99 * v_b + 0.01 * g_b**2
        rate = 0.02 / (1 + step / rounds)
        w -= rate * (m_w / (1 - 0.9**step)) / (np.sqrt(v_w / (1 - 0.99**step)) + 1e-8)
        b -= rate * (m_b / (1 - 0.9**step)) / (np.sqrt(v_b / (1 - 0.99**step)) + 1e-8)
    table[kept] = w * r
    return {"table": table, "bias": float(b)}


def score(text: str, model: dict) -> float:
    """Probability of label 1: the summed weights of the features present."""
    p, table = points(text), model["table"]
    found = []
    for n in ORDERS:
        f = hashed(p, n)
        found.append(f[table[f] != 0])
    z = float(table[np.unique(np.concatenate(found))].sum(dtype=np.float64)) + model["bias"]
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def learnt(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, learn_chars: int):
    """The broadcast model of at most ``sample`` labelled rows that aren't held out,
    of texts of at most ``learn_chars`` characters."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = labelled_sample(id_and_text(docs, id_col, text_col), labels, id_col, label_col, sample, learn_chars)
    return spark.sparkContext.broadcast(fit([(t, y) for _, t, y in rows]))


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    sample: int = SAMPLE,
    learn_chars: int = LEARN_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and
    no other; scores and odd cases as in ``toxicity``."""
    model = learnt(docs, labels, id_col, text_col, label_col, sample, learn_chars)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t, model.value) < threshold for t in texts_of(batch, at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    sample: int = SAMPLE,
    learn_chars: int = LEARN_CHARS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    A row's score depends on its text alone.  Null and empty texts get the score of
    a text without features; null labels aren't learnt from; without labels of both
    classes every score is the known class's smoothed share.  Repeated rows get
    equal results, null doc_ids pass and are never held out, further columns are
    ignored, an empty table gives an empty result.  What ``sample`` and
    ``learn_chars`` leave out of learning is scored like the rest."""
    model = learnt(docs, labels, id_col, text_col, label_col, sample, learn_chars)
    scored = map_text(id_and_text(docs, id_col, text_col), lambda texts: {"score": [score(t, model.value) for t in texts]}, "score double", ["_id"])
    out = scored.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
