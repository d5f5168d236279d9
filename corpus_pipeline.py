"""The corpus pipeline: stages that each apply one training-data operator.

Toxic documents go, then exact duplicates, then near duplicates; the rest is put
in the order of the sources' mix and encoded, each row with its position in it.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns of any name, and keeps the columns it is given (the last one
returns its own); what it does with such rows is stated at its operator and below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, exact_dedup, minhash, mixing, toxicity
from weftline.llm.common import materialise, table
from weftline.llm.queries import mix_weights, splitting_pattern, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.7; rules for odd rows as in toxicity.toxicity."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with most code points, then the smallest doc_id.  Null
    and empty texts are one text; a row without doc_id stays where it is the only one."""
    return exact_dedup.keep_first(docs, materialise(exact_dedup.exact_duplicates(docs), "exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group.  Texts without words and rows
    without doc_id stay."""
    return minhash.keep_first(docs, minhash.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix, which their files and rows keep.  Null sources
    are a source of their own; rows of equal doc_id follow in any order."""
    mixed = mixing.mix(docs, mix_weights())
    return mixing.in_order(mixed, docs.select("doc_id").count()).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, position, n_tokens, ids_sha256, decoded_sha256, ids) of the mixed rows, as
    written; null and empty texts have no ids.  ``docs`` must be read from files, as
    run() and a writer of stages do, since files and rows give the position."""
    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), splitting_pattern()
    placed = mixing.placed(docs).withColumnRenamed("__position", "position")
    return bpe.round_trip(placed, path, pattern, with_ids=True, keep=["position"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores, near-duplicate components and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
