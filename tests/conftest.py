import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from barloom.operators.calendar import announced_calendar, calendar_dimension  # noqa: E402
from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="barloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dim(spark):
    """Dimension of the announced 2026 calendar."""
    return calendar_dimension(announced_calendar(spark)).cache()
