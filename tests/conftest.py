import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tagflow.session import clear_state, get_session

    s = get_session("local[4]", 4, extra={"spark.driver.memory": "6g"})
    yield s
    clear_state(s)
    s.stop()
