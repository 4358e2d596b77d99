import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shipgraph.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="shipgraph-tests",
                      extra={"spark.driver.memory": "6g"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shipgraph-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def edges(spark):
    def make(rows):
        return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows],
                                     "src string, dst string, weight double")
    return make
