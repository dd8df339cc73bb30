"""One local session for all tests; workers find the package by PYTHONPATH."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from eventloom.runtime import session

    s = session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same():
    """Whether a Spark result and a DuckDB result hold the same rows, in any order."""
    import datetime
    import decimal
    import math

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, bool | str | bytes):
            return x
        if isinstance(x, int | float | decimal.Decimal):
            return round(float(x), 6)
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None)
        if isinstance(x, list | tuple):
            return tuple(map(plain, x))
        return x

    def check(df, con, sql):
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
        b = sorted(repr(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True)))) for r in want.fetchall())
        assert a == b

    return check


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con
