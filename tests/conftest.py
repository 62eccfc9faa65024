import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reviewlake.session import build_session

    session = build_session("local[4]", 4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one Column on one row."""
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]
    return run
