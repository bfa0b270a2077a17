import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lacuna.session import local_session

    return local_session(4, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture()
def work(spark):
    from lacuna.session import WorkDir

    w = WorkDir(spark, "test")
    yield w
    w.remove()
