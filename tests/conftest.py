import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhouse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    return build_session("8", "tests", **{"spark.checkpoint.dir": str(work), "spark.sql.warehouse.dir": str(work / "warehouse")})


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
