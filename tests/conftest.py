import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from paperroute.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as dicts, in a stable order."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((r.asDict() for r in picked.collect()), key=lambda d: [str(x) for x in d.values()])

    return collect
