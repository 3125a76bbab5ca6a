import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glossweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tiny inputs: compiling stages would take longer than running them
    s = build_session(master="local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.driver.memory": "6g",
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
