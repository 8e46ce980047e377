import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)

from nearloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "nearloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def unit():
    """n random unit vectors as float32."""

    def make(n, dim, seed=0):
        x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame ``id_col, embedding`` of a matrix."""

    def make(x, id_col="vec_id", ids=None):
        ids = range(len(x)) if ids is None else ids
        rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, x)]
        return spark.createDataFrame(rows, f"{id_col} bigint, embedding array<float>")

    return make
