import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from labelforge.session import build_session
    s = build_session("local[4]", 4, app_name="labelforge-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lf-test-ckpt-")})
    yield s
    s.stop()
