import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codelode.session import local_session, share_code

    s = local_session(4, "tests", **{"spark__sql__shuffle__partitions": "4"})
    share_code(s)
    yield s
    s.stop()
