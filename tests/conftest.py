import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chainlens.session import get_spark
    s = get_spark("local[4]", 4, "chainlens-tests",
                  {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="chainlens-test-ckpt-"),
                   "spark.driver.memory": "4g"})
    yield s
    s.stop()
