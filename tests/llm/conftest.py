import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, component string, score double, held_out string"


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents table with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), 7, "x", "y", 0.5, "z") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables to a folder that queries read."""

    def make(**tables):
        root = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"file://{root}/{name}.parquet")
        return f"file://{root}"

    return make
