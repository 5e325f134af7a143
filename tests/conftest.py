import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vecfactor.session import build_session
    s = build_session(master="local[4]", cores=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_shared(spark):
    """A fresh folder below the session's shared checkpoint folder."""
    from vecfactor.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="vf-test-", dir=base)
