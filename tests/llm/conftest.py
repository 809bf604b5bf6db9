import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """``documents(texts)``: rows with ids from 0 on, or (id, text) pairs."""

    def build(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)

    return build


#: Columns named like the operators' own.
CLASH = ["_id", "_text", "_n", "_key", "_block", "_source", "score", "component_id", "kept", "a", "b", "start", "_row"]


@pytest.fixture
def clashing():
    def add(df):
        return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))

    return add
