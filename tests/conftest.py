import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from souklens.session import get_session

    s = get_session("local[*]", 8, app="souklens-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="souklens-test-ckpt-"),
                           # one JVM runs the whole suite (every job's plan is built several times)
                           "spark.driver.memory": "4g"})
    yield s
    s.stop()
