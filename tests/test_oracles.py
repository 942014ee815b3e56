"""Every registered query outside the training-data operators against its oracle, on the smallest tables."""

import importlib
import math

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
PLANS = [importlib.import_module(f"tidemark.plans.{n}") for n in ("technical", "fundamentals", "dataset", "news", "catalog", "merges", "landed")]
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PLANS for k, v in p.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = plain(got.select(*columns).collect()), plain(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(abs(p - q) <= 1e-3 + 1e-9 * abs(q) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y, strict=True)), (x, y)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
