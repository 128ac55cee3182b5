import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from wavetable.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SMALL


def same(df, relation) -> None:
    """Rows of a DataFrame and of a DuckDB relation, whatever their order."""

    def plain(v):
        if isinstance(v, float):
            return float(f"{v + 0.0:.8g}")
        return tuple(map(plain, v)) if isinstance(v, list) else v

    cols = sorted(relation.columns)
    assert sorted(df.columns) == cols
    at = [relation.columns.index(c) for c in cols]
    left = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert left == right
