import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def all_documents(spark, sf_dir):
    return {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, and columns with the operators' own names."""
    long_text = " ".join(f"word{k % 1000} and mail{k}@example.com" for k in range(20_000))
    rows = [
        (1, "one plain text of a few words that stand here once", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, " \n\t ", "de"),
        (5, long_text, "en"),
        (6, "one plain text of a few words that stand here once", "en"),
        (7, "x", "fr"),
        (7, "x", "fr"),
        (None, "a text without a key but with words of its own", "en"),
        (None, None, None),
        (8, "été à Zürich 中文 🙂 ΑΣ", None),
        (9, "y" * 100_000, "en"),
    ]
    clashing = ("row_id", "score", "kept", "size", "slot", "shard", "rank", "tie", "fingerprint", "component_id", "n_tokens", "kept_id", "contaminated_id")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumns({name: F.lit("clash") for name in clashing})
