from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size string, slot string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang]) rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), 7, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
