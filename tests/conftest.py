import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foliant.session import build_session

    return build_session(cores=8, memory="6g", app="tests", **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint"))})
