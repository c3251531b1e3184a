import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


@pytest.fixture(scope="session")
def spark():
    from quadrat.session import build_session
    s = build_session("quadrat-tests", master="local[4]", shuffle_partitions=8)
    # Tests may run where no checkpoint folder is configured: give them one.
    from quadrat.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="quadrat-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def wood(spark):
    from quadrat.sources.catalog import read_table
    return read_table(spark, DATA, "wood").cache()


@pytest.fixture(scope="session")
def coarse(spark):
    from quadrat.sources.catalog import read_table
    return read_table(spark, DATA, "coarse_wood").cache()
