"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, host_paths, minhash, mixing, packing, quality_knn, quality_rules, secrets, toxicity
from .common import table, work_path


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, splitting_pattern())


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_path(spark, "token-shards")
    return packing.write_and_read(docs, tokenizer_file("byte_bpe_50k.json"), path, end=2)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op9_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.main_text(table(spark, sf_dir, "pages"))


def mix_weights() -> dict[str | None, float]:
    """Target weights: the first source four parts, the next four two each, others one."""
    return {f"src{i}": 4.0 if i == 0 else 2.0 if i < 5 else 1.0 for i in range(20)}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.mix(docs, mix_weights())
    names = ("phase", "block", "release", "due", "slot", "position")
    return mixed.withColumnsRenamed({f"__{n}": n for n in names})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_byte_bpe,
        op3_token_output,
        op4_secret_scan,
        op5_toxicity,
        op6_quality_knn,
        op7_exact_dedup,
        op8_quality_rules,
        op9_html_consensus,
        op10_source_mixing,
    )
}

def _quality_sql() -> str:
    """The rules in SQL: windows are numbered words joined by a space."""
    q = quality_rules
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    size = lambda x, p: f"(length({x}) - length(regexp_replace({x}, {quote(p)}, '', 'g')))"
    chars = lambda x: f"length(regexp_replace({x}, {quote(q.SPACE)}, '', 'g'))"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, {quote(q.SPACE)}), lambda x: x <> '') AS ws FROM d),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
        rep AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM twice) GROUP BY doc_id),
        l AS (SELECT * FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {quote(q.WORD)})),
        j AS (SELECT *, len(regexp_extract_all(line, {quote(q.WORD)})) AS n FROM l),
        f AS (SELECT *, 2 * {size("line", q.MARKS)} >= n OR (n < {q.SHORT_LINE} AND NOT regexp_matches(line, {quote(q.TERMINAL)}))
            OR ({size("line", q.SEPARATORS)} >= 3 AND 3 * {size("line", q.SEPARATORS)} >= n) OR regexp_matches(line, {quote(q.BOILERPLATE)}) AS fails FROM j),
        g AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum({chars("line")}) FILTER (fails), 0) AS removed FROM f GROUP BY doc_id),
        o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({chars("t")} AS BIGINT) AS word_chars, CAST({size("t", q.SYMBOLS)} AS BIGINT) AS n_symbols,
            CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_chars
            FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN g USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
        SELECT *, NOT base_failed AND 100 * removed_chars <= 50 * word_chars AS kept FROM b"""


ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS k FROM w),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
        FROM r LEFT JOIN c USING (doc_id) GROUP BY doc_id""",
    "op8_quality_rules": _quality_sql(),
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (w ORDER BY n_points DESC, doc_id) AS keep_id,
               count(*) OVER w AS group_size, doc_id = first_value(doc_id) OVER (w ORDER BY n_points DESC, doc_id) AS kept,
               h AS text_sha256, n_points
        FROM d WINDOW w AS (PARTITION BY h)""",
}
