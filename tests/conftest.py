import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from lexweave.session import local_session

    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture
def same(duck):
    """Compare a DataFrame with DuckDB SQL: column names, and rows in any order."""

    def check(df, sql):
        rel = duck.execute(sql)
        names = [c[0] for c in rel.description]
        cols = sorted(df.columns)
        assert sorted(names) == cols
        want = sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
        assert got == want

    return check
