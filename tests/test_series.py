"""Sums over sorted series in numpy against Spark's own windows, and what the features' plans hold."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling, series
from tidemark.operators import technical as t
from tidemark.sources import projections as p

SF = "/root/testdata/sf0.001"


def odd_rows():
    """Series of 1 to 90 rows: gaps, a first known value late, nothing known, NaN and infinity."""
    r = random.Random(4)
    for company, n in ((1, 90), (2, 1), (3, 37), (None, 64), (5, 12), (6, 40), (7, 40)):
        for k in range(n):
            x = r.gauss(100, 9) if r.random() > 0.1 and company != 5 and not (company == 3 and k < 9) else None
            y = {(6, 20): math.nan, (7, 15): math.inf}.get((company, k), r.gauss(0, 1))
            yield company, k, x, y


@pytest.mark.parametrize(("batch", "block"), [(7, 16), (11, 1), (10_000, 32_768)])
def test_series_equal_windows(spark, monkeypatch, batch, block):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(list(odd_rows()), "company_id long, trade_date long, __x double, __y double")
        at = F.row_number().over(t.W()) - 1
        spec = {f"{kind}_{c}": (kind, f"__{c}", 21) for kind in ("sum", "least", "greatest") for c in "xy"}
        spec |= {"qx": ("products", "__x", "__x", 21), "xy": ("products", "__x", "__y", 21), "ex": ("ewm", "__x", 0.2, 9), "ey": ("ewm", "__y", 1 / 14, 3), "rx": ("running", "__x")}
        got = series.with_series(df.withColumn(series.AT, at), spec, ["company_id", "trade_date"])
        got = {r[:2]: r.asDict() for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    start = {f"{k}_{c}": F.col(f"__{c}") for k in ("s", "lo", "hi") for c in "xy"} | rolling.moments_of("x", "y")
    want = rolling.over_last(rolling.pieces(df, start, rolling.united, dict.fromkeys(start, 4)), 21, start, rolling.united)
    want = rolling.ewm(want, {"ex": ("__x", 0.2, 9), "ey": ("__y", 1 / 14, 3)}).withColumn("rx", F.sum("__x").over(t.W().rowsBetween(Window.unboundedPreceding, 0)))
    names = {f"{kind}_{c}": f"__n21_{k}_{c}" for kind, k in (("sum", "s"), ("least", "lo"), ("greatest", "hi")) for c in "xy"}
    names |= {"qx": "__n21_q_x", "xy": "__n21_c_x_y", "ex": "ex", "ey": "ey", "rx": "rx"}
    rows = want.collect()
    assert len(rows) == len(got)
    for row in rows:
        for a, b in names.items():
            mine, theirs = got[row["company_id"], row["trade_date"]][a], row[b]
            # Null and NaN are told apart; extremes past a NaN are not compared, since Spark holds NaN for the greatest number.
            if a in ("least_y", "greatest_y") and row["company_id"] == 6:
                continue
            if mine is None or theirs is None:
                assert mine is theirs, (row["company_id"], row["trade_date"], a, mine, theirs)
            elif math.isfinite(theirs):
                assert mine == pytest.approx(theirs, rel=1e-9, abs=1e-9), (row["company_id"], row["trade_date"], a)
            else:
                assert not math.isfinite(mine), (row["company_id"], row["trade_date"], a, mine, theirs)


def test_features_sort_bars_once_and_copy_no_wide_row_by_window(spark):
    bars = p.bars(spark, SF, 6)
    plan = t.technical_features(bars, p.index_series(bars), dealt=True)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    # Earlier rows' values and the market's overlap; forty windows over all columns before.
    assert plan.count("Window [") <= 2 and plan.count("MapInArrow") == 1


def test_features_keep_other_columns_and_odd_days(spark):
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(k), "x", 1.0, 3.0 + k % 4, 1.0 + k % 3, 2.0 + k % 5, 10 * k) for c in (1, None) for k in range(70)]
    bars = spark.createDataFrame(rows, "company_id long, trade_date date, note string, open double, high double, low double, close double, volume long")
    index = bars.filter("company_id = 1").select("trade_date", F.col("close").alias("market"))
    got = t.technical_features(bars, index)
    assert got.columns == [*bars.columns, *t.FEATURES] and got.count() == 140
    assert got.filter("note = 'x' and volume_sma_20 is not null").count() == 102


def test_known_bits_are_those_of_the_features(spark):
    bars = p.bars(spark, SF, 6)
    clean = t.scaled(t.clean_prices(bars, "provider_split_adjusted"))
    df = t.technical_features(clean.select("company_id", "trade_date", *t.INPUTS), p.index_series(bars), True, known="bits")
    assert df.filter(F.col("bits") != t.known_bits(t.FEATURES)).count() == 0 and df.agg(F.bit_or("bits")).first()[0] == (1 << 45) - 1
    # One sum and one least day for all features at once.
    plan = t.known_counts(df, "bits")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("min(") <= 6


def test_newest_rows_hold_the_last_value_of_every_feature(spark):
    from tidemark.operators import valuation as v

    gone = F.when((F.col("company_id") % 3 == 0) & (F.col("trade_date") > "1998-06-01"), F.lit(None).cast("double"))
    bars = p.bars(spark, SF, 6).withColumn("volume", F.when(F.col("company_id") % 4 != 0, F.col("volume"))).withColumn("close", F.coalesce(gone, F.when((F.col("company_id") % 3 != 0) | (F.col("trade_date") <= "1998-06-01"), F.col("close"))))
    wide = t.technical_features(bars.select("company_id", "trade_date", *t.INPUTS), p.index_series(bars), True, newest="last").persist()
    some = wide.filter("last = 1")
    read = lambda df: {r[0]: r[1] for r in v.latest_columns(df, t.FEATURES, "trade_date", "m").collect()}
    assert 0 < some.count() < wide.count() / 5
    want, got = read(wide), read(some)
    assert len({len(m) for m in want.values()}) > 1 and {k: m for k, m in want.items() if m} == {k: m for k, m in got.items() if m}
