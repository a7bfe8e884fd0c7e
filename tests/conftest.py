import os

import pytest

from columnscout.session import get_spark

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("COLUMNSCOUT_MEMORY", "4g")
    home = tmp_path_factory.mktemp("spark")
    session = get_spark("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=f"file://{home}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest tables; tests that need it are skipped where it isn't there."""
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
