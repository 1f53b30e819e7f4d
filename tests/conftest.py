import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
os.environ.setdefault("PYTHONPATH", str(ROOT))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tablescope.session import get_spark

    session = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """make(rows, ddl): a small frame."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)
