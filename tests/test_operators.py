"""Point-in-time joins, ratios, valuation, news, datasets, merges and company selection on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog as c
from tidemark.operators import dataset as d
from tidemark.operators import fundamentals as f
from tidemark.operators import news as n
from tidemark.operators import sinks as s
from tidemark.operators import valuation as v
from tidemark.operators.asof import asof_join, latest_by

D = dt.date


def test_asof_keeps_whole_rows(spark):
    left = spark.createDataFrame([(1, D(2025, 1, 1)), (1, D(2025, 1, 20)), (1, D(2025, 3, 5)), (2, D(2025, 3, 5))], "company_id long, t date")
    right = spark.createDataFrame([(1, D(2025, 1, 20), 0.1, 5.0), (1, D(2025, 3, 1), 0.2, None)], "company_id long, at date, nm double, roe double")
    rows = [tuple(r) for r in asof_join(left, right, "company_id", "t", "at").orderBy("company_id", "t").collect()]
    assert rows == [(1, D(2025, 1, 1), None, None), (1, D(2025, 1, 20), 0.1, 5.0), (1, D(2025, 3, 5), 0.2, None), (2, D(2025, 3, 5), None, None)]
    known = asof_join(left, right, "company_id", "t", "at", per_column=True).filter("t = '2025-03-05' and company_id = 1").first()
    assert known["roe"] == 5.0
    assert latest_by(right, ["company_id"], ["at"]).first()["nm"] == 0.2


def items(spark, rows):
    full = [(1, kind, f"{end.year}FY", end, end + dt.timedelta(days=120), code, value) for kind, end, code, value in rows]
    return spark.createDataFrame(full, "company_id long, statement_type string, fiscal_period string, period_end date, available_at date, account_code string, value double")


def test_ratios_use_the_price_known_then(spark):
    i = items(spark, [("annual", D(2024, 12, 31), k, x) for k, x in (("revenue", 100.0), ("net_income", 10.0), ("total_equity", 0.0), ("eps_basic", -1.0), ("shares_outstanding", 10.0))])
    prices = spark.createDataFrame([(1, D(2025, 4, 29), 50.0), (1, D(2025, 4, 30), None), (1, D(2025, 5, 5), 999.0)], "company_id long, trade_date date, close double")
    got = {r["ratio_name"]: (r["value"], r["is_applicable"]) for r in f.ratios(i, prices).collect()}
    assert got["net_margin__annual"] == (0.1, True) and got["roe__annual"] == (None, False) and got["price_to_earnings__annual"] == (None, False)
    better = items(spark, [("annual", D(2024, 12, 31), k, x) for k, x in (("eps_diluted", 5.0), ("eps_basic", 4.0), ("total_equity", 100.0), ("shares_outstanding", 10.0))])
    got = {r["ratio_name"]: r["value"] for r in f.ratios(better, prices).collect()}
    assert got["price_to_earnings__annual"] == 10.0 and got["price_to_book__annual"] == 5.0
    assert f.completeness(i).first()["quality_status"] == "data_tidak_mencukupi"


def test_disclosed_metrics(spark):
    rows = [("annual", D(2023, 12, 31), "earning_assets", 100.0)]
    rows += [("annual", D(2024, 12, 31), k, x) for k, x in (("earning_assets", 300.0), ("net_interest_income", 10.0), ("npl_gross_ratio_reported", 0.03), ("gross_loans", 80.0), ("customer_deposits", 160.0))]
    companies = spark.createDataFrame([(1, "Financials", "Banks")], "company_id long, sector string, industry string")
    got = {r["metric_name"]: r["value"] for r in f.disclosed_metrics(items(spark, rows), companies).collect()}
    assert got == {"net_interest_margin_pct": 5.0, "npl_gross_pct": 3.0, "loan_to_deposit_ratio_pct": 50.0}


def test_reserve_life_needs_one_known_unit(spark):
    i = items(spark, [("annual", D(2024, 12, 31), k, x) for k, x in (("proven_probable_reserves", 90.0), ("annual_production", 30.0), ("stripping_ratio_reported", 4.0))])
    companies = spark.createDataFrame([(1, "Coal mining", "Coal")], "company_id long, sector string, industry string")
    plain = {r["metric_name"]: (r["value"], r["unit"]) for r in f.disclosed_metrics(i, companies).collect()}
    assert plain == {"stripping_ratio": (4.0, "ratio"), "proven_probable_reserves": (90.0, "unit"), "annual_production": (30.0, "unit")}
    for pair, life in ((("Mt", "Mt"), (3.0, "years")), (("Mt", "kt"), None), (("Mt", None), None)):
        units = i.filter("account_code like '%pro%'").withColumn("unit", F.when(F.col("account_code") == "annual_production", F.lit(pair[1])).otherwise(F.lit(pair[0])))
        got = {r["metric_name"]: (r["value"], r["unit"]) for r in f.disclosed_metrics(i, companies, units).collect()}
        assert got.get("reserve_life_years") == life and got["proven_probable_reserves"] == (90.0, "Mt")


def test_negated_events_are_no_events(spark):
    said = [("perusahaan tidak pailit", None), ("bukan fraud", None), ("Tanpa pernah gagal bayar; lalu PAILIT", "default_or_insolvency"), ("tidak bagi dividen", "dividend"), ("tidak dividen", None), (None, None), ("", None)]
    df = spark.createDataFrame(said, "x string, want string")
    assert all(r["c"] == r["want"] for r in df.withColumn("c", n.financial_event(F.col("x"))["category"]).collect())


def test_cash_flow_value(spark):
    cols = [F.lit(x) for x in (100.0, 50.0, 20.0, 10.0)]
    three, grid = v.cash_flow_scenarios(*cols, v.Assumptions(0.12, 0.06, 0.03, 5))
    r = spark.range(1).select(three.alias("t"), grid.alias("g")).first()
    base = sum(100 * 1.06**y / 1.12**y for y in range(1, 6)) + 100 * 1.06**5 * 1.03 / 0.09 / 1.12**5
    assert r["t"]["bear"] < r["t"]["base"] < r["t"]["bull"] and len(r["g"]) == 9
    assert r["t"]["base"] == pytest.approx((base + 30) / 10) and r["g"]["discount_0.1200__growth_0.0600"] == r["t"]["base"]
    bad = spark.range(1).select(v.value_per_share(*cols, 0.03, 0.06, 0.03, 5).alias("a"), v.value_per_share(F.lit(-1.0), *cols[1:], 0.12, 0.06, 0.03, 5).alias("b")).first()
    assert bad["a"] is None and bad["b"] is None


def test_valuation_from_own_history(spark):
    days = [D(2019 + i, 12, 31) for i in range(5)]
    ratios = [(1, "annual", f"{e.year}FY", e, e + dt.timedelta(days=120), name, val, True) for e, pe, pb, bv in zip(days, (8, 9, 10, 11, 12), (1.0, 1.2, 1.4, 1.6, 1.8), (50, 51, 52, 53, 54), strict=True)
              for name, val in (("price_to_earnings__annual", float(pe)), ("price_to_book__annual", pb), ("book_value_per_share__annual", float(bv)))]
    r = spark.createDataFrame(ratios, "company_id long, statement_type string, fiscal_period string, period_end date, available_at date, ratio_name string, value double, is_applicable boolean")
    i = items(spark, [("annual", days[-1], "eps_basic", 10.0)])
    companies = spark.createDataFrame([(1, "A", "n", "s", "i", "equity", "active")], "company_id long, ticker string, company_name string, sector string, industry string, asset_type string, status string")
    bars = spark.createDataFrame([(1, D(2024, 6, 1), 95.0), (1, D(2025, 6, 1), 1.0)], "company_id long, trade_date date, close double")
    got = v.valuations(companies, i, r, bars, F.lit("2024-07-01").cast("date"))
    row = got.first()
    assert row["fair_value_base"] == pytest.approx((100.0 + 75.6) / 2) and row["current_price"] == 95.0 and row["n_methods"] == 2
    assert row["methods_used"] == {"relative_pe_historical": 0.5, "relative_pb_historical": 0.5}
    rec = v.recommendations(got, r).first()
    assert rec["label"] == "DATA_TIDAK_MENCUKUPI" and rec["guardrails"] == ["fundamental_quality_not_computable"]


def test_entities_and_finance_rules(spark):
    companies = spark.createDataFrame([(1, "BBCA", "PT Bank Central Asia Tbk"), (2, "EMAS", "Gold"), (3, "XYZ", "PT Unrelated Company Tbk")], "company_id long, ticker string, company_name string")
    aliases = spark.createDataFrame([(3, "OLDX", None)], "company_id long, previous_ticker string, previous_name string")
    texts = [(1, "Laba bank  CENTRAL-asia naik; harga emas turun"), (2, "BBCA dan OLDX"), (3, "nothing"), (4, None)]
    articles = spark.createDataFrame(texts, "article_id long, text string")
    got = {(r["article_id"], r["company_id"]): r["match_method"] for r in n.entity_links(articles, n.dictionary(companies, aliases)).collect()}
    assert got == {(1, 1): "company_name", (2, 1): "ticker", (2, 3): "previous_ticker"}
    said = [("Laba bersih naik tajam", 1), ("tidak pernah gagal bayar", 0), ("gagal bayar dan rugi bersih, pendapatan turun", -2), ("bukan laba naik; laba naik", 0), ("bukan laba naik. " + "x " * 30 + "laba naik", 1)]
    df = spark.createDataFrame(said, "x string, want int")
    assert all(r["s"] == r["want"] for r in df.withColumn("s", n.finance_signal(F.col("x"))).collect())
    p = n.calibrated(F.lit(1), F.lit(0.1), F.lit(0.8), F.lit(0.1))
    row = spark.range(1).select(*(c.alias(k) for k, c in p.items())).first()
    assert sum(row) == pytest.approx(1.0) and row["positive"] == pytest.approx(0.65 / (0.65 + 0.415 + 0.0), rel=1e-6)
    ctx = spark.range(1).select(n.company_context(F.lit("One. BBCA rose! Two?"), F.lit("BBCA"), F.lit("zzz")).alias("x")).first()["x"]
    assert ctx == "BBCA rose!"
    pairs = spark.createDataFrame([(1, 1, "x"), (2, 1, None)], "article_id long, company_id long, matched_text string")
    done = spark.createDataFrame([(1, 1, "v")], "article_id long, company_id long, model_version string")
    assert [r["article_id"] for r in n.score_pairs(pairs, articles, companies, "v", done).collect()] == [2]


def test_split_purges_and_metrics(spark):
    sp = d.Split(D(2025, 1, 10), D(2025, 1, 11), D(2025, 1, 20), D(2025, 1, 21), D(2025, 1, 31), 2)
    df = spark.createDataFrame([(D(2025, 1, k),) for k in (3, 10, 13, 14, 25)], "t date")
    got = [r[0] for r in df.orderBy("t").select(d.split_of(F.col("t"), 5, sp)).collect()]
    assert got == ["train", None, "validation", "validation", "test"]
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    m = d.classification_metrics(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double"), "y", "p").first()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert m["roc_auc"] == pytest.approx(np.mean(pairs)) and m["brier"] == pytest.approx(np.mean((p - y) ** 2))
    assert d.classification_metrics(spark.createDataFrame([(1, 0.7)], "y int, p double"), "y", "p").first()["roc_auc"] is None
    r = d.regression_metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "y double, p double"), "y", "p").first()
    assert r["mae"] == 1.0 and r["median_ae"] == 1.0 and r["spearman"] == pytest.approx(0.8660254)
    a = d.default_split(D(2020, 1, 1), D(2020, 12, 31))
    assert (a.train_end, a.validation_end) == (D(2020, 8, 25), D(2020, 10, 19))


def test_merges_are_idempotent(spark, tmp_path):
    t = lambda x: dt.datetime(2024, 1, x)
    shape = "company_id long, trade_date date, close double, retrieved_at timestamp"
    old = spark.createDataFrame([(1, D(2024, 1, 1), 1.0, t(1)), (None, D(2024, 1, 1), 5.0, t(1))], shape)
    new = spark.createDataFrame([(1, D(2024, 1, 1), 2.0, t(2)), (1, D(2024, 1, 2), 3.0, t(2)), (None, D(2024, 1, 1), 6.0, t(2))], shape)
    once = s.upsert(old, new, ["company_id", "trade_date"])
    assert sorted(r["close"] for r in once.collect()) == [2.0, 3.0, 6.0] and s.upsert(once, new, ["company_id", "trade_date"]).count() == 3
    a = spark.createDataFrame([("u", "old", "first")], "url string, title string, media string")
    b = spark.createDataFrame([("u", None, "second"), ("w", "x", "y")], "url string, title string, media string")
    assert sorted(map(tuple, s.upsert_columns(a, b, ["url"], ["title"]).collect())) == [("u", None, "first"), ("w", "x", "y")]
    assert s.append_absent(a, b, ["url"]).count() == 2 and s.replace_keys(a, b, ["url"]).count() == 2
    s.replace_partitions(old.fillna(0).withColumn("year", F.year("trade_date")), f"{tmp_path}/p", "year")
    s.replace_partitions(new.fillna(0).withColumn("year", F.lit(2025)), f"{tmp_path}/p", "year")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 5
    docs = spark.createDataFrame([(1, "pdf", t(3)), (1, "xbrl", t(1)), (2, "pdf", t(1))], "k long, fmt string, retrieved_at timestamp")
    assert sorted((r["k"], r["fmt"]) for r in s.by_source_priority(docs, ["k"], F.col("fmt") == "xbrl").collect()) == [(1, "xbrl"), (2, "pdf")]
    al = "company_id long, previous_ticker string, previous_name string, effective_from date, effective_to date, reason string"
    x = spark.createDataFrame([(1, "old", None, D(2020, 1, 1), None, "a")], al)
    y = spark.createDataFrame([(1, "OLD", None, D(2020, 1, 1), D(2021, 1, 1), "b")], al)
    assert [tuple(r) for r in s.upsert_aliases(x, y).collect()] == [(1, "old", None, D(2020, 1, 1), D(2021, 1, 1), "b")]
    bars = spark.createDataFrame([(1, D(2024, 1, 1), "raw"), (1, D(2024, 1, 2), "raw")], "company_id long, trade_date date, quality_status string")
    checked = spark.createDataFrame([(1, D(2024, 1, 1), "mismatch")], "company_id long, trade_date date, status string")
    assert sorted(r["quality_status"] for r in s.reconcile_back(bars, checked).collect()) == ["raw", "reconciled_mismatch"]


def test_batches(spark):
    companies = spark.createDataFrame([(i, f"T{i:02d}", f"Name {i}", "equity", "active", "Energy") for i in range(10)], "company_id long, ticker string, company_name string, asset_type string, status string, sector string")
    assert sorted(r["ticker"] for r in c.spread_sample(companies, 4).collect()) == ["T00", "T02", "T05", "T07"]
    assert c.search_companies(companies, "t0", limit=3).first()["total"] == 10
    at = F.lit("2024-01-01").cast("timestamp")
    results = spark.createDataFrame([(1, None), (2, "no data for x"), (3, "boom")], "company_id long, message string")
    log = c.attempt_log(results, "prices", at)
    assert {r["company_id"]: r["status"] for r in log.collect()} == {1: "succeeded", 2: "no_data", 3: "failed"}
    attempts = log.withColumn("id", F.col("company_id")).unionByName(log.filter("company_id = 2").withColumn("id", F.lit(9)).withColumn("retry_after", F.lit(None).cast("timestamp")))
    left = c.eligible(companies, attempts=attempts, now=F.lit("2024-01-01 00:30:00").cast("timestamp"))
    assert sorted(r["company_id"] for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    many = spark.createDataFrame([(i, "err") for i in range(30)], "company_id long, message string")
    summary = c.failure_summary(c.attempt_log(many, "p", at)).first()
    assert summary["failures"] == 30 and len(summary["first"]) == 20
    listed = spark.createDataFrame([("T00", "New", "equity"), ("ZZ", "Z", "etf")], "ticker string, company_name string, asset_type string")
    change = {r["ticker"]: r["change"] for r in c.sync_companies(companies, listed).collect()}
    assert (change["T00"], change["ZZ"], change["T01"], len(change)) == ("updated", "created", "unchanged", 11)
    a = spark.createDataFrame([("2024FY", "x")], "p string, v string")
    b = spark.createDataFrame([("2024FY", "y"), ("2023FY", "z")], "p string, v string")
    assert sorted(map(tuple, c.merged_periods(a, b, ["p"]).collect())) == [("2023FY", "z"), ("2024FY", "x")]
