import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from threadmetrics.session import get_spark
    s = get_spark(master="local[8]", shuffle_partitions=8, app_name="threadmetrics-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
