from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def medium():
    return "/root/testdata/sf0.1"
