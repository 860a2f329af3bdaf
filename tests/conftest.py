import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from arborlens.session import session

    s = session("local[4]", "tests", 4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
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
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def same(frame, relation):
    """Columns, and rows without order, of a DataFrame and a DuckDB relation."""
    show = lambda v: "null" if v is None else repr(v) if isinstance(v, float) else str(v)
    columns = sorted(frame.columns)
    mine = sorted(tuple(show(r[c]) for c in columns) for r in frame.collect())
    names = [x[0] for x in relation.description]
    assert columns == sorted(names)
    theirs = sorted(tuple(show(r[names.index(c)]) for c in columns) for r in relation.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
