from __future__ import annotations

import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
