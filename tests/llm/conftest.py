import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows."""

    def rows(*docs):
        full = [(d[0], d[1], None, d[2] if len(d) > 2 else "s", None if d[1] is None else len(d[1])) for d in docs]
        return spark.createDataFrame(full, SCHEMA)

    return rows


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty, blank and long texts, repeated rows, a shared doc_id, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    df = make((1, None), (2, ""), (3, " \t\n "), (4, "a b c", None), (4, "a b c", None), (5, long), (6, long + " end"), (None, "no id here"), (None, None, None), (7, "..., !!!"), (7, "other text of one id"), (8, "  é ß \U0001f600"))
    clash = ("size", "digest", "row", "words", "h", "w", "i", "term", "pos", "bucket", "blob", "doc", "tag", "fp", "key", "shard", "slot", "vslot", "item", "win", "near", "spans", "target", "taken", "sid", "source_key", "upto", "at", "host", "tokens", "score", "lang_pred", "label", "template", "text_hash", "k_id", "cuts", "copy", "times")
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def empty(make, spark):
    return spark.createDataFrame([], SCHEMA)
