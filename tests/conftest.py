import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleanery.session import local_session, ship_package  # noqa: E402

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield ship_package(session)


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("test tables are not here")
    return str(SF)
