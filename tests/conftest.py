from __future__ import annotations

import pytest

from ramagem.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
