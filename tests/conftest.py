import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8, app_name="ledgerlens-tests",
                      extra={"spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture(scope="session")
def tiny(spark):
    from tests.fixtures import tiny_tables
    return tiny_tables(spark)
