import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the smallest table, in order."""
    return duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet' order by doc_id").fetchall()
