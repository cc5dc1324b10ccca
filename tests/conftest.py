import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cropspark.session import get_session

    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as dictionaries, sorted by the given columns."""

    def take(df, *order):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple((r[c] is None, str(r[c])) for c in order)) if order else out

    return take
