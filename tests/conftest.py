from __future__ import annotations

import pytest

from tests.compare import duck, session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_duck(small_dir):
    return duck(small_dir)
