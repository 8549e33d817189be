import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docassay.operators.scan import set_hot_rows  # noqa: E402
from docassay.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", 4, str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def hot():
    """Force the chunked path: every key above three rows counts as heavy."""
    set_hot_rows(3)
    yield
    set_hot_rows(None)


@pytest.fixture(scope="session")
def folder():
    return SMALL
