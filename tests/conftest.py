import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from reportlake.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "8"})
    checkpoint_dir(s)  # creates a private folder only when the session names none
    yield s
    s.stop()
