import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from firmlake.session import build_session

    session = build_session(
        "firmlake-tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def folder(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("run"))
