import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ties."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "one", "A b c d", "a B c d", long, long + " more", "same text here", "same text here", "naïve café 漢字 <|endoftext|>", "x " * 500]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "same text here", None, "s1", 3), (None, "no id", "en", "s1", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
