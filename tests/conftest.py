import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codesift.runtime import local_session

    session = local_session(4, partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted tuples of a frame."""

    def collect(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    return collect
