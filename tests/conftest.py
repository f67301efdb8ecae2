import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]])


@pytest.fixture(scope="session")
def spark():
    from sangam.session import get_session

    s = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g", spark__driver__host="127.0.0.1", spark__sql__execution__arrow__maxRecordsPerBatch="500")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
