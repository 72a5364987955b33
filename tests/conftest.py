import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barograph.session import get_session

    session = get_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def market(spark):
    from barograph.sources.market import Market

    return Market(spark, FOLDER)
