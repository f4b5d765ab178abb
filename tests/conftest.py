from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from keepstone.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{sf}/{f}'")
    return c


@pytest.fixture(scope="session")
def duck():
    return oracle("sf0.001")
