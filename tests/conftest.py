import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402

from postmill.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "4", 4)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
