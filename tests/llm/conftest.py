import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, position string, key__ int, hits__ string, accepted__ int, term string, tier int, text_src string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank, wordless and very long texts, repeated rows, clashing names."""
    long = "whale ship ocean captain " * 40_000
    prose = "The quick brown fox jumps over the lazy dog while seven quiet owls watch from the old barn roof"
    base = [
        (1, prose, "en", "a", len(prose)),
        (1, prose, "en", "a", len(prose)),  # repeated row
        (2, prose, "en", "b", len(prose)),  # equal text
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (5, "  \n\t ", "en", "a", 5),
        (6, "!!! ??? ...", "en", "a", 11),
        (None, "A text without any id has words as well", "en", "a", 39),
        (None, None, None, None, None),
        (7, long, "en", "a", len(long)),
        (8, "été \U0001f600 中文 naïve \x00 zero", "fr", "a", 20),
    ]
    return spark.createDataFrame([(*r, 9, "p", 9, "h", 9, "t", 9, "s") for r in base], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
