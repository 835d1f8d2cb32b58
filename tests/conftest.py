import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shipshape.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", 4, app="shipshape-tests")
    ensure_checkpoint_dir(s)  # a private checkpoint folder when none is configured
    yield s
