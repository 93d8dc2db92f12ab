import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orrery.session import local_session, ship

    session = local_session(8, partitions=4, memory="6g")
    yield ship(session)
    session.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def same_rows(df, con, sql):
    """Both engines' rows as sorted lists of values by column name."""
    cols = sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    return mine, theirs
