import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from orbweave.session import local_session

    return local_session(4, "4g", 4)
