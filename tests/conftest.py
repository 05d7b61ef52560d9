import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from placeloom.session import local_session

    session = local_session("tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return f"{DATA}/sf0.001"
