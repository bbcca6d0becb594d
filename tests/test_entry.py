import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOG = [n for n in entry.oracle_sql() if not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CATALOG)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    answer = duck.execute(entry.oracle_sql()[name])
    at = [d[0] for d in answer.description]
    assert sorted(at) == columns
    want = sorted(([plain(float(r[at.index(c)]) if type(r[at.index(c)]).__name__ == "Decimal" else r[at.index(c)]) for c in columns] for r in answer.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
