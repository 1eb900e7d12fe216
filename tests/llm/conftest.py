import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute as B  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(B.awkward_rows(), B.SCHEMA)
    return rows.withColumns({c: F.lit(f"own {c}") for c in B.CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], B.SCHEMA)
