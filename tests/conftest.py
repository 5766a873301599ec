import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("ledgerlens-tests", cpus="*", shuffle_partitions=8, driver_memory="4g")
    yield s
    s.stop()


def rows(df, order=None):
    """Collect a small test result as a list of dicts (tests only)."""
    if order:
        df = df.orderBy(*order)
    return [r.asDict(recursive=True) for r in df.collect()]
