import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside themselves
CLASHING = ["sha", "key", "fp", "_id", "_key", "size", "target", "ids", "block", "rid", "bucket", "place", "shard", "slot", "tid", "chunk", "digest", "kept",
            "letters", "copies", "rank", "first", "word count", "a.b"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text, lang, source) rows -> documents, in three partitions, with many extra columns."""
    def make(rows):
        df = spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows], SCHEMA).repartition(3)
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return make


ODD = [
    (1, "The cat sat on the mat and looked at the other cat.", "en", "a"),
    (2, "The cat sat on the mat and looked at the other cat.", "en", "a"),  # a copy
    (3, "The cat sat\ton the mat  and looked at the other cat. ", None, "b"),  # equal without white space, longer
    (4, None, "en", "a"), (5, "", "de", None), (6, " \n\t ", None, None), (7, "12 34 !!", "fr", "c"), (None, "un deux trois quatre", "fr", "c"),
    (None, None, None, None), (8, "Der Hund und die Katze liegen auf der Bank im Garten.", "de", "ß"), (9, "un deux trois quatre", "fr", "C"),
    (10, "word " * 30_000, "en", "a"), (11, "x" * 60_000, "es", "a"), (12, "漢字 😀 \x00 ▁ é", "es", "😀"),
    (13, "same row", "en", "a"), (13, "same row", "en", "a"), (13, "same row", "en", "a"), (14, "A b C d E f", "en", "b"), (15, "a B c D e F", "en", "b"),
    (14, "another text under the same id", "en", "b"),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD).cache()


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs(ODD).filter("false")
