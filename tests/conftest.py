import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from nestwell.session import local_session

    s = local_session(4, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.default.parallelism": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def store(spark, tmp_path):
    from nestwell.sources.store import Options, Store, Verification

    return Store(spark, str(tmp_path / "store"), Options(verification=Verification.READ_BACK))
