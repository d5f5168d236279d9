import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    return [(None, "a null id here"), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (6, long), (7, long + " end"), (8, "ONE  two")]


@pytest.fixture(scope="session")
def clashing(docs_of, odd_rows):
    """The odd rows with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    d = docs_of(odd_rows)
    for c in ("_id", "_t", "n", "node", "key", "size", "score", "bucket", "digest", "row", "path", "host", "kept", "component"):
        d = d.withColumn(c, F.lit("x"))
    return d
