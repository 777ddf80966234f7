import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    session = local_session(4, partitions=4, spark__driver__memory="3g", spark__sql__adaptive__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
