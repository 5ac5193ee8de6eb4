from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Columns that operators use inside, as a user's table may have them too.
CLASHING = ("row", "size", "key", "n", "kept", "component", "rid", "place", "copies", "ids", "w", "tokens")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names clash."""

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})

    return make
