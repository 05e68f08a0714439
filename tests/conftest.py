import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from faultcast.session import build_session

    spark = build_session("local[*]", app="faultcast-tests", shuffle_partitions=8,
                          extra={"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="faultcast-test-ckpt-")})
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def small_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    return SMALL
