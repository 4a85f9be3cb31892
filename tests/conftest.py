import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from auricle.session import local_spark
    from auricle.streaming.decisions import ROCKSDB

    session = local_spark(4, **{"spark.sql.shuffle.partitions": "4"}, **ROCKSDB)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
