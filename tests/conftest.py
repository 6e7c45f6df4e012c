import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from veilmeter.session import local_session

    return local_session("veilmeter-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
