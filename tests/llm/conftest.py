import duckdb
import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(id, text) pairs -> documents with the columns of the table."""

    def make(rows, extra=""):
        rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def sample():
    """Some whole documents of the driver's smallest table."""
    return duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
