import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cohortscope.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4",
                      spark__ui__enabled="false", spark__driver__memory="6g",
                      spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
                      spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def ws(spark, sf):
    from cohortscope.plans.workspace import Workspace

    return Workspace.of(spark, sf)
