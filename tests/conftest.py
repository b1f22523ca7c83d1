from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from crowdgauge.runtime import session

    spark = session("crowdgauge-tests", master="local[4]", partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
