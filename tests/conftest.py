import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from brushwork.session import local_session

    return local_session("tests", cores="8", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
