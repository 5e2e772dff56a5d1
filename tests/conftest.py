import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallycard.session import local_session

    return local_session("8", checkpoint_dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
