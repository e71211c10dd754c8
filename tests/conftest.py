import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from scorespark.session import ensure_checkpoint_dir, local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("FATAL")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
