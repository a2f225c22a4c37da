import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, hash string, place int, words string, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of texts, with extra columns whose names clash with the operators' own."""

    def make(texts, langs=None, sources=None, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or [f"s{k % 3}" for k in range(len(texts))])[k], None if t is None else len(t), 1, "h", 2, "w", 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest driver tables, and odd ones."""
    import pyarrow.dataset as ds

    texts = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    return [*texts, None, "", " ", "\n\n", "!!!", "a", "A b", "é à ß 中文 😀", "x" * 50_000, "the same line\n" * 400, texts[0], texts[0].upper(), texts[1] + " one more"]
