import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session, ship

    return ship(local_session(8, 4, **{"spark.driver.memory": "4g"}))


@pytest.fixture(scope="session")
def data():
    d = Path(os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001"))
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)
