"""Scalar rules, rolling windows and exponential averages against plain Python and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rolling, rules
from tidemark.operators import technical as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def bars(spark, closes, company=1, volumes=None, spread=5.0):
    day = dt.date(2020, 1, 1)
    rows = [
        (company, day + dt.timedelta(days=i), c, None if c is None else c + spread, None if c is None else c - spread, c, c, int(v))
        for i, (c, v) in enumerate(zip(closes, volumes or [100] * len(closes), strict=True))
    ]
    return spark.createDataFrame(rows, "company_id long, trade_date date, open double, high double, low double, close double, adjusted_close double, volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("company_id", "trade_date").collect()]


def test_calendar_equals_counting_days(spark):
    start = dt.date(2024, 2, 20)
    days = [start + dt.timedelta(days=i) for i in range(25)]
    pairs = [(a, b) for a in days for b in days]
    df = spark.createDataFrame(pairs, "a date, b date").select("a", "b", rules.trading_days_between("a", "b").alias("n"), rules.previous_trading_day("a").alias("p"))
    for r in df.collect():
        inside = [r["a"] + dt.timedelta(days=i) for i in range(1, (r["b"] - r["a"]).days + 1)]
        assert r["n"] == sum(d.weekday() < 5 for d in inside)
        before = r["a"] - dt.timedelta(days=1)
        while before.weekday() >= 5:
            before -= dt.timedelta(days=1)
        assert r["p"] == before


def test_freshness(spark):
    monday = F.lit("2024-03-04 10:00:00").cast("timestamp")
    day = lambda x: F.lit(x).cast("date")
    got = [one(spark, rules.freshness(day(d), monday)) for d in ("2024-03-01", "2024-02-29", "2024-02-27", "2024-02-20")]
    assert got == ["fresh", "awaiting_eod", "provider_delayed", "stale"]
    assert one(spark, rules.freshness(F.lit(None).cast("date"), monday)) == "stale"


def test_all_errors_of_a_bar_are_reported(spark):
    rows = [(dt.date(2024, 1, 2), 10.0, 9.0, 11.0, 0.0, -5), (dt.date(2024, 1, 2), 10.0, 12.0, 9.0, None, 5), (dt.date(2030, 1, 1), 1.0, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "trade_date date, open double, high double, low double, close double, volume long")
    got = [r[0] for r in df.select(rules.bar_errors(F.lit("2024-06-01").cast("date"))).collect()]
    assert got[0] == [
        "close must be > 0, got 0.0", "high (9.0) < open (10.0)", "high (9.0) < low (11.0)", "low (11.0) > open (10.0)", "low (11.0) > close (0.0)",
        "volume must be >= 0, got -5",
    ]
    assert got[1] == [] and got[2] == ["trade_date 2030-01-01 is in the future"]


def test_price_policy(spark):
    df = bars(spark, [10.0, None]).withColumn("internal_close", F.lit(7.0))
    price, source = rules.resolved_price("internally_verified_adjusted")
    assert [tuple(r) for r in df.select(price, source).collect()] == [(7.0, "internal")] * 2
    price, source = rules.resolved_price("provider_all_adjusted")
    assert [tuple(r) for r in df.orderBy("trade_date").select(price, source).collect()] == [(10.0, "provider"), (None, "raw_fallback")]
    with pytest.raises(ValueError):
        rules.resolved_price("best")


def test_company_rules(spark):
    kinds = [("Common Stock", "A"), (" INDEX ", "B"), (None, "JKSE Index"), ("", "Big ETF"), ("warrant", "W"), (None, "Plain")]
    df = spark.createDataFrame(kinds, "t string, n string")
    assert [r[0] for r in df.select(rules.asset_type("t", "n")).collect()] == ["equity", "index", "index", "etf", "other", "equity"]
    code = one(spark, rules.sector_code(F.lit("Financials"), F.lit("Banks & Other Very Long Names Of Things")))
    assert len(code) == 32 and code.startswith("banks_other_very_long")
    assert one(spark, rules.fiscal_period(F.lit("2024-06-30").cast("date"), F.lit("quarterly"))) == "2024Q2"
    assert one(spark, rules.available_date(F.lit("2024-12-31").cast("date"), F.lit("annual"))) == dt.date(2025, 4, 30)
    assert one(spark, rules.formula_route(F.lit("Energy"), F.lit("Oil & Gas E&P"))) == "mining"


@pytest.mark.parametrize(
    ("position", "quality", "label"),
    [
        ("undervalued", "healthy", "LAYAK_DIBELI"), ("undervalued", "mixed", "AKUMULASI_BERTAHAP"), ("undervalued", "weak", "HINDARI"),
        ("overvalued", "healthy", "TUNGGU_HARGA"), ("fair", "mixed", "HOLD"), (None, "healthy", "DATA_TIDAK_MENCUKUPI"), ("fair", None, "DATA_TIDAK_MENCUKUPI"),
    ],
)
def test_labels(spark, position, quality, label):
    assert one(spark, rules.recommendation_label(F.lit(position).cast("string"), F.lit(quality).cast("string"))) == label


def test_confidence_rounds_half_to_even(spark):
    assert one(spark, rules.confidence(F.lit(0.5), F.lit(3))) == 0.75
    assert one(spark, rules.confidence(F.lit(None).cast("double"), F.lit(3))) == 0.0
    assert one(spark, rules.reported_percent(F.lit(0.2875))) == pytest.approx(28.75) and one(spark, rules.reported_percent(F.lit(3.2))) == 3.2


@pytest.mark.parametrize(("block", "group"), [(7, 256), (7, 3), (1024, 256)])
@pytest.mark.parametrize("share", [0.0, 0.3])
def test_ewm_equals_pandas(spark, monkeypatch, block, group, share):
    monkeypatch.setattr(rolling, "BLOCK", block)
    monkeypatch.setattr(rolling, "GROUP", group)
    rng = np.random.default_rng(int(share * 10) + block)
    values = [None if rng.random() < share else float(x) for x in rng.normal(100, 5, 120)]
    df = spark.createDataFrame([(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for k in (1, 2) for i, v in enumerate(values)], "company_id long, trade_date date, x double")
    got = column(rolling.ewm(df, {"a": ("x", 0.2, 9), "b": ("x", 1 / 14, 14)}), "a")[:120]
    want = pd.Series(values, dtype=float).ewm(alpha=0.2, adjust=False, min_periods=9).mean()
    assert [x is None for x in got] == want.isna().tolist()
    assert np.allclose([x for x in got if x is not None], want.dropna(), rtol=1e-10)


def test_ewm_of_a_million_rows_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("company_id"), F.col("id").alias("trade_date"), F.when(F.col("id") % 11 != 0, 100 + F.sin("id")).alias("x"))
    got = rolling.ewm(df, {"a": ("x", 0.001, 9)}).filter("trade_date % 9973 = 9 or trade_date >= 999990").select("trade_date", "a").toPandas().set_index("trade_date")["a"]
    k = np.arange(n)
    want = pd.Series(np.where(k % 11 != 0, 100 + np.sin(k), np.nan)).ewm(alpha=0.001, adjust=False, min_periods=9).mean()
    known = got.index >= 10
    assert np.allclose(got[known], want[got.index[known]], rtol=1e-9)


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0)], "g string, x double")
    got = df.select("g", "x", rolling.percent_rank_mean("x", "g").alias("r"), rolling.percentile_midpoint("x", "g").alias("m")).orderBy("g", F.col("x").asc_nulls_last()).collect()
    assert [r["r"] for r in got] == [pytest.approx(1 / 3), pytest.approx(2.5 / 3), pytest.approx(2.5 / 3), None, 1.0]
    assert [r["m"] for r in got] == [pytest.approx(100 / 6), pytest.approx(200 / 3), pytest.approx(200 / 3), None, None]


def test_features_equal_pandas_with_gaps(spark):
    rng = np.random.default_rng(7)
    closes = (1000 * np.exp(np.cumsum(rng.normal(0, 0.01, 150)))).tolist()
    closes[40] = None
    df = t.own_features(bars(spark, closes, volumes=[1000 + 10 * i for i in range(150)]))
    s = pd.Series(closes, dtype=float)
    assert np.allclose(pd.Series(column(df, "sma_20"), dtype=float), s.rolling(20).mean(), equal_nan=True)
    assert np.allclose(pd.Series(column(df, "bb_upper_20"), dtype=float), s.rolling(20).mean() + 2 * s.rolling(20).std(), equal_nan=True)
    assert np.allclose(pd.Series(column(df, "ema_12"), dtype=float), s.ewm(span=12, adjust=False, min_periods=12).mean(), equal_nan=True)
    d = s.diff()
    g, l = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    assert np.allclose(pd.Series(column(df, "rsi_14"), dtype=float), 100 - 100 / (1 + g / l), equal_nan=True)
    macd = s.ewm(span=12, adjust=False, min_periods=12).mean() - s.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(pd.Series(column(df, "macd_signal"), dtype=float), macd.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True)


def test_feature_edge_cases(spark):
    rising = t.own_features(bars(spark, [float(100 + i) for i in range(40)]))
    assert column(rising, "rsi_14")[-1] == 100.0 and column(rising, "mfi_14")[-1] == 100.0
    flat = t.own_features(bars(spark, [100.0] * 40, spread=0.0))
    assert column(flat, "hist_vol_20")[-1] == 0.0 and column(flat, "stoch_k_14")[-1] is None and column(flat, "rsi_14")[-1] is None
    small = t.own_features(bars(spark, [10.0, 11.0, 10.0, 12.0], volumes=[100, 200, 300, 400]))
    assert column(small, "obv") == [0.0, 200.0, -100.0, 300.0]
    jump = t.clean_prices(bars(spark, [1000.0, 1010.0, None, 2500.0]))
    assert column(jump, "is_outlier_flagged") == [False, False, False, True]


def test_market_features_need_overlap(spark):
    rng = np.random.default_rng(3)
    m = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90)))
    r = np.diff(m) / m[:-1]
    closes = [50.0]
    for x in r:
        closes.append(closes[-1] * (1 + 2 * x))
    b = bars(spark, [float(c) for c in closes])
    index = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(m)], "trade_date date, market double")
    got = t.market_features(b, index)
    assert column(got, "beta_60")[-1] == pytest.approx(2.0) and column(got, "alpha_60")[-1] == pytest.approx(0.0, abs=1e-12)
    few = t.market_features(b, index.limit(50))
    assert set(column(few, "relative_strength_5")) == {None}


def test_split_adjustment_and_labels(spark):
    b = bars(spark, [100.0, 100.0, 50.0, 50.0])
    splits = spark.createDataFrame([(1, dt.date(2020, 1, 3), 1, 2, True), (1, dt.date(2020, 1, 2), 1, 10, False)], "company_id long, ex_date date, split_from int, split_to int, is_verified boolean")
    assert column(t.internally_adjusted(b, splits), "internal_close") == pytest.approx([50.0, 50.0, 50.0, 50.0])
    got = t.forward_labels(b, (1,))
    assert column(got, "fwd_return_1d") == [0.0, -0.5, 0.0, None] and column(got, "direction_1d") == [0, 0, 0, None]


def test_frames_of_doubled_pieces_equal_pandas(spark):
    k = np.arange(700)
    values = np.where(k % 150 == 149, np.nan, 100 + 10 * np.sin(k)) + np.where(k == 20, 1e9, 0)
    rows = [(1, int(i), None if np.isnan(v) else float(v)) for i, v in zip(k, values, strict=True)]
    df = spark.createDataFrame(rows, "company_id long, trade_date long, __x double")
    start = {"s_x": F.col("__x"), "lo_x": F.col("__x")} | rolling.moments_of("x")
    df = rolling.over_last(rolling.pieces(df, start, rolling.united, dict.fromkeys(start, 6)), 100, start, rolling.united)
    got = df.orderBy("trade_date").toPandas()
    s = pd.Series(values).rolling(100)
    direct = pd.Series([np.nan if i < 99 else values[i - 99 : i + 1].var(ddof=1) for i in k])
    for name, want in (("__n100_s_x", s.sum()), ("__n100_lo_x", s.min()), ("__n100_m_x", s.mean())):
        assert np.allclose(got[name].astype(float), want, equal_nan=True, rtol=1e-9), name
    # What has left the frame leaves no trace: the 1e9 of row 20 is not felt from row 120 on.
    assert np.allclose(got["__n100_q_x"].astype(float) / 99, direct, equal_nan=True, rtol=1e-9)
    # One sort serves every level.
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_feature_partitions_are_not_united_by_the_size_of_bars(spark):
    many = bars(spark, [100.0 + i % 7 for i in range(300)])
    index = many.select("trade_date", F.col("close").alias("market"))
    plan = t.technical_features(many, index)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_known_counts_equal_the_long_table(spark):
    many = bars(spark, [100.0 + i % 7 for i in range(300)])
    wide = t.technical_features(many, many.select("trade_date", F.col("close").alias("market"))).persist()
    want = t.long_features(wide).groupBy("company_id", "feature_name", "version").agg(F.count("*").alias("n"), F.min("feature_date").alias("first_date"))
    got = t.known_counts(wide)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
