from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parents[1]), os.environ.get("PYTHONPATH", "")])

import brute  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    frame = spark.createDataFrame(brute.documents(), brute.SCHEMA).repartition(5, "n_chars")
    return frame.cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], brute.SCHEMA)
