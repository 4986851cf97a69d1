import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("ORRERY_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from orrery.session import session

    s = session("local[4]", app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
