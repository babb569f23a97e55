import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowers import FLOWER_COLUMNS, FLOWER_SCHEMA, flower_rows  # noqa: E402
from foldwise.frame import Frame  # noqa: E402
from foldwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def flowers(spark) -> Frame:
    df = spark.createDataFrame(flower_rows(), FLOWER_SCHEMA).coalesce(1).cache()
    return Frame.of(df, "id")


@pytest.fixture(scope="session")
def flower_file(tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("flowers") / "flowers.tsv"
    lines = ["\t".join(FLOWER_COLUMNS)]
    lines += ["\t".join("" if c is None else str(c) for c in r) for r in flower_rows()]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="session")
def clouds(spark) -> Frame:
    """Three separable clouds with string labels."""
    rng = np.random.default_rng(0)
    n = 300
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + 3.0 * np.eye(4)[label]
    rows = [(i, f"c{label[i]}", *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, label string, a double, b double, "
                                     "c double, d double").coalesce(1).cache()
    return Frame.of(df, "row_id", "label")
