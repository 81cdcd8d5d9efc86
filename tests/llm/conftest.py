import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 97}x{i % 13}" for i in range(60_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))


def rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows and rows with one key."""
    return [
        (1, "The cat sat on the mat.", "en", "b", 23), (2, "the CAT sat on the mat.", "en", "a", 23), (3, "", "en", "a", 0), (4, None, None, None, None), (None, "no key here at all", "en", None, 18),
        (5, " \n\t ", "de", "c", 4), (6, LONG, "de", "a", len(LONG)), (7, "Ärger ÜBER Öl", "de", "ü", 13), (8, "ärger über öl", "de", "ü", 13), (9, BASE, "en", "a", 1), (10, BASE + " tail", "en", "b", 1),
        (11, BASE.upper(), "en", None, 1), (12, "12 34 56 78", "en", "a", 11), (12, "12 34 56 78", "en", "a", 11), (12, "another text for twelve", "en", "a", 23), (None, "no key here at all", "en", None, 18), (13, "word", "fr", "zz", 4),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns with the operators' own names, in other cases too."""
    from pyspark.sql import functions as F

    names = ["KEPT", "size", "shard", "slot", "score", "Lang_Pred", "ids", "decoded", "taken", "target", "component_id", "__hash", "text_sha256", "spans", "held", "n_words"]
    return docs.withColumns({n: F.lit("x") for n in names})
