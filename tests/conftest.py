import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from warehaul.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda row: [(v is None, "" if v is None else v) for v in row])
