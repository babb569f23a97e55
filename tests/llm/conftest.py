import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import SCHEMA, TEXTS, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a repeated row, a null id, nulls elsewhere, and names that may clash."""
    rows = rows_of(TEXTS)
    rows += [rows[8], (None, "one two three four five six", None, None, None, None, None, None,
                       None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
