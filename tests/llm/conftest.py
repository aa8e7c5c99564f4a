import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that share names with what operators add or join on.
CLASHING = ["block", "bucket", "print", "least", "root", "cut_doc", "n_lines_", "h1", "pos", "line", "word", "score", "start", "piece"]


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text, lang, source) rows, with extra columns of clashing names on demand."""
    from pyspark.sql import functions as F

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df

    return make


LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "   \n\n ", None, "b"),
    (4, LONG, "en", "a"),
    (5, "one two three four five six seven eight nine ten", "en", "a"),
    (6, "one two three four five six seven eight nine ten", "en", "b"),
    (6, "one two three four five six seven eight nine ten", "en", "b"),
    (None, "a row without a number", "en", "c"),
    (7, "Größe  der\tStraße – naïve 中文 😀", "de", "c"),
    (8, "123 !!", "en", "a"),
]


@pytest.fixture(scope="session")
def awkward():
    return AWKWARD
