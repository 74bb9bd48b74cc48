import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ctxweave.runtime import prepare, session

    s = session(4, 4, **{"spark.driver.memory": "3g", "spark.local.dir": str(tmp_path_factory.mktemp("local"))})
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
