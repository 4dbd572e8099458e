import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stratus.session import build_session

    warehouse = tempfile.mkdtemp(prefix="stratus-test-warehouse-")
    s = build_session(
        "local[4]", app="stratus-tests", shuffle_partitions=4,
        extra={"spark.sql.warehouse.dir": warehouse},
    )
    if not s.conf.get("spark.checkpoint.dir", None) and s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratus-test-ckpt-"))
    yield s
    s.stop()
