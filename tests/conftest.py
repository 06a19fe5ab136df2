import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stepcorpus.session import get_session
    s = get_session(cores=4, shuffle_partitions=8, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="stepcorpus-test-")


def rows(df, *cols):
    """Collect selected columns as plain tuples (sorted)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
