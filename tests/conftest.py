import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("SPANWRIGHT_PARTITIONS", "4")
os.environ.setdefault("SPANWRIGHT_DRIVER_MEMORY", "3g")

import pytest  # noqa: E402

from spanwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")
