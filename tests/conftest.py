from __future__ import annotations

import os
from pathlib import Path

import pytest

from termscan.session import local_session

TESTDATA = Path(os.environ.get("TERMSCAN_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "4g", str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("test tables not present")
    return str(folder)


@pytest.fixture
def files_of(spark):
    """Build a files table from (path, text) pairs."""
    from pyspark.sql import functions as F

    from termscan.sources.tables import texts_as_files

    def build(*pairs):
        table = spark.createDataFrame(list(pairs), "p string, t string")
        return texts_as_files(table, F.col("p"), F.col("t"))

    return build
