import pytest

from zocalo.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "tests", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
