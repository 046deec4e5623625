import os

import pytest

# Python workers import the operators by name.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table, with an extra column, from texts or (id, text[, lang[, source]])."""

    def make(rows, parts=3):
        full = []
        for k, row in enumerate(rows):
            row = (k, row) if row is None or isinstance(row, str) else tuple(row)
            row = row + (None, None)[: 4 - len(row)] if len(row) < 4 else row
            full.append((row[0], row[1], row[2], row[3], len(row[1] or ""), "x"))
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def given(spark):
    """Rows of the given documents as (id, text)."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
