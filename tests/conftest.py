import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame({"a": [...], ...}) with every column text unless it holds numbers."""

    def make(columns: dict, schema: str | None = None):
        names = list(columns)
        rows = list(zip(*columns.values()))
        return spark.createDataFrame(rows, schema or ", ".join(f"`{n}` string" for n in names))

    return make
