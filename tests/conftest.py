"""Shared Spark session for the tests (local mode, 8 shuffle partitions)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from issuelens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="issuelens-tests")
    from issuelens.sources.tables import SPREAD_SETTING
    s.conf.set(SPREAD_SETTING, "8")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("driver test tables are not present")
    return SF_SMALL
