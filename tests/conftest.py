import os
import sys
from pathlib import Path

import pytest
from hypothesis import settings

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from textfacts.session import local_session  # noqa: E402

settings.register_profile("unhurried", deadline=None)  # first calls load libraries
settings.load_profile("unhurried")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "textfacts-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def fresh(tmp_path):
    """Paths that do not exist yet."""
    return lambda name: os.path.join(str(tmp_path), name)


@pytest.fixture(scope="session")
def folder():
    return SMALL


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns or df.columns).collect()]
