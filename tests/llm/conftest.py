import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use themselves
          "size long, target double, rate string, part int, hash string, node long, key string, code string, "
          "text_hash long, component long, kept boolean, places string, row string, n_lines int, copies int")
FILL = (9, 9.0, "r", 9, "h", 9, "k", "c", 9, 9, True, "p", "w", 9, 9)


def edge_rows():
    """Null, empty, blank, short, equal, repeated and very long texts, null ids and sources."""
    text = "The quick brown fox jumps over the lazy dog near the old stone bridge\nsecond line"
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(40_000))
    rows = [(1, text, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n \r\n", "en", "b"),
            (5, "one two", "en", "b"), (6, "one two", "en", None), (7, text + " and more", "en", "c"),
            (8, text, None, "c"), (8, text, None, "c"), (None, text, "en", "a"), (None, "alone here", "en", "a"),
            (None, None, None, None), (9, long, "en", "d"), (10, "Ünïcödé \U0001f600 テスト\nThe END", "de", "d")]
    return [(i, t, la, s, None if t is None else len(t)) + FILL for i, t, la, s in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """The documents of the smallest tables, and their rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
