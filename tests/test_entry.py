import math
import os

import duckdb
import pytest

from lettermill.plans import registry

#: Queries that may find nothing in the smallest tables.
MAY_BE_EMPTY = ("ledger_strangers", "pending_batch", "attempt_keys", "request_keys", "near_dup_edges_exact", "near_dup_edges", "similarity_components", "group_crossings")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6f}"
    return value if value is None or isinstance(value, str | bool) else f"{float(value):.6f}"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    expected = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted(str(tuple(plain(v) for v in r)) for r in rows)
    wanted = key(expected.fetchall())
    assert key(got.select(*columns).collect()) == wanted
    assert wanted or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "lettermill")):
        if os.path.basename(folder) == "llm":
            continue
        for name in (n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                assert "lettermill.llm" not in f.read()
