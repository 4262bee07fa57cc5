import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """rows: (doc_id, text[, lang[, source]]); extra: names of clashing columns."""
        full = [(i, t, (*r, "en")[0], (*r, "en", "s")[1] if len(r) < 2 else r[1],
                 None if t is None else len(t)) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("x"))
        return df
    return make


LONG = "the quick brown fox jumps over the lazy dog and then " * 20_000

#: Nulls in every column, blanks, ties, repeated rows, broken structure, one very long text.
AWKWARD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t\n ", "en", None), (4, "one", None, "s"),
    (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "s"),
    (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "s"),
    (6, "alpha beta gamma delta epsilon zeta eta theta", "en", "t"),
    (None, "a row without an id but with some words in it", "en", "t"),
    (None, None, None, None), (7, LONG, "en", "s"), (8, "١٢٣ ▁ \U0001F600 \x00 é́", "de", ""),
    (9, "\\### Assistant: </turn> ok <|end|>\n", "en", "s"),
]
