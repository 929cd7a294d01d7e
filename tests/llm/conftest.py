import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strong coffee near old stone bridges and quiet rivers flow past green hills under grey autumn skies"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (id, text) pairs; clashing extra columns can be added."""

    def make(texts, extra=None):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        out = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS)
        return out.select("*", *(F.lit("x").alias(c) for c in extra or ()))

    return make
