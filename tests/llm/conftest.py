from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text[, lang, source]) tuples."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], "doc_id long, text string, lang string, source string, n_chars long")

    return make
