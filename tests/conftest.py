from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from starloom.session import session, ship

    made = tmp_path_factory.mktemp("spark")
    s = session("tests", cores=4, partitions=4, spark__sql__warehouse__dir=str(made / "warehouse"), spark__driver__memory="4g", spark__checkpoint__dir=str(made / "shared"))
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
