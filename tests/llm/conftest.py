import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; tables may have them too.
CLASHING = ["row", "part", "run", "digest", "id", "keep_id", "kept", "head", "fp", "root", "component_id", "label", "score", "places", "grp", "words", "lines", "n", "value", "kind", "moved"]

ODD = [
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "Same words here, and some more of them to make it long."),
    (9, "same words here, and some more of them to make it long."),
    (9, "same words here, and some more of them to make it long."),
    (9, "another text under the same id as the one before"),
    (None, "same words here, and some more of them to make it long."),
    (None, "a text without any id at all"),
    (10, "word " * 30_000),
    (11, "one"),
    (12, "ünïcödé ÀÉ text with odd\x0bspaces and\x0cmore"),
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as a documents table over several partitions, with columns whose names clash if asked for."""

    def make(rows, clashing=False):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
        return docs.withColumns({name: F.lit(name) for name in CLASHING}) if clashing else docs

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD, clashing=True)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([], clashing=True)
