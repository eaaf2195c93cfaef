import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from attesta.session import build_session

    return build_session("tests", cpus=4, shuffle=4)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
