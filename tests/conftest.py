import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orderloom.session import build_session

    session = build_session("local[8]", 4, **{
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="orderloom-tests-")})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
