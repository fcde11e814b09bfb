from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from sheetweave.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(3, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
