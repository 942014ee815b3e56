"""Landed payloads and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed
from tidemark.streaming import jobs


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_json_bars(spark, tmp_path):
    path = put(tmp_path, "b.json", json.dumps({"symbol": "A", "values": [{"datetime": "2024-01-02", "open": "1.5", "high": "2", "low": "", "close": "x", "volume": "10"}]}))
    assert rows(landed.json_bars(spark, path), "trade_date", "open", "low", "close", "volume") == [(dt.date(2024, 1, 2), 1.5, None, None, 10)]
    path = put(tmp_path, "c.json", json.dumps([{"symbol": "A", "date": "2024-01-02", "close": 3.5, "volume": 7}]))
    assert rows(landed.close_only_bars(spark, path), "open", "close") == [(None, 3.5)]
    nan = spark.createDataFrame([(1, dt.date(2024, 1, 1), float("nan"), 1.0, 1.0, 1.0, 1.0, float("nan"))], landed.BAR)
    assert rows(landed.columnar_bars(nan), "open", "volume") == [(None, None)]


def test_actions_and_listing(spark, tmp_path):
    d = spark.createDataFrame([("A", dt.date(2024, 1, 5), 2.0), ("A", dt.date(2020, 1, 5), 2.0)], "ticker string, ex_date date, amount double")
    s = spark.createDataFrame([("A", dt.date(2024, 2, 5), 0.1), ("B", dt.date(2024, 2, 5), 3.0)], "ticker string, ex_date date, ratio double")
    day = lambda x: F.lit(x).cast("date")
    got = rows(landed.corporate_actions(d, s, day("2024-01-01"), day("2024-12-31")).fillna(0), "action_type", "split_from", "split_to")
    assert got == [("cash_dividend", 0.0, 0.0), ("reverse_split", 10.0, 1.0), ("stock_split", 1.0, 3.0)]
    path = put(tmp_path, "a.json", json.dumps({"symbol": "A", "dividend": [{"ex": "2024-01-05"}], "split": [{"date": "bad"}]}))
    assert rows(landed.nested_actions(spark, path, {"dividend": "ex", "split": "date"}), "action_type", "ex_date") == [("dividend", dt.date(2024, 1, 5)), ("split", None)]
    raw = spark.createDataFrame([("BBCA.JK", " Bank ", "x"), ("", "n", "x"), ("C", None, "x")], "symbol string, name string, type string")
    assert rows(landed.listing(raw), "ticker", "company_name") == [("BBCA", "Bank")]


def test_series(spark, tmp_path):
    path = put(tmp_path, "f.json", json.dumps({"observations": [{"date": "2024-01-02", "value": "5.33"}, {"date": "2024-01-03", "value": "."}]}))
    assert rows(landed.dotted_observations(spark, path, "s"), "value", "available_at") == [(5.33, dt.datetime(2024, 1, 2, 20))]
    path = put(tmp_path, "w.json", json.dumps([{"page": 1}, [{"date": "2024", "value": 5.033}, {"date": "2025", "value": None}]]))
    assert rows(landed.annual_pair(spark, path, "s"), "observation_date", "value") == [(dt.date(2024, 12, 31), 5.033)]
    cube = {"datacontent": {"999914501251": 0.5, "9999145012512": 0.7, "9999145012513": 9.0, "88881450": 1.0}, "tahun": [{"val": "125", "label": "2025"}]}
    path = put(tmp_path, "c.json", json.dumps(cube))
    got = rows(landed.cube(spark, path, "s", "145"), "observation_date", "value", "available_at")
    assert got == [(dt.date(2025, 1, 31), 0.5, dt.datetime(2025, 2, 11)), (dt.date(2025, 12, 31), 0.7, dt.datetime(2026, 1, 11))]
    html = "<table><tr><td>14 Agustus 2023</td><td>4.25 %</td></tr><tr><td>bad</td><td>1</td></tr><tr><td>3 Mei 2023</td><td>Rp12.480,50</td></tr></table>"
    got = rows(landed.html_rates(spark, put(tmp_path, "h.html", html), "s"), "observation_date", "value", "available_at")
    assert got == [(dt.date(2023, 5, 3), 12480.5, dt.datetime(2023, 5, 3, 16)), (dt.date(2023, 8, 14), 4.25, dt.datetime(2023, 8, 14, 16))]


def test_sheet(spark):
    cells = [(0, 2, "2017.0"), (0, 5, "2018"), (0, 1, "Title")]
    cells += [(1, 1, "Jan"), (1, 2, "Feb"), (1, 3, "Feb"), (1, 4, "Jan"), (1, 5, "Mar")]
    cells += [(2, 1, "5.5"), (2, 2, "5.6"), (2, 3, "5.7"), (2, 4, "-"), (2, 5, "6.0")]
    df = spark.createDataFrame(cells, "row_no int, col_no int, value string")
    assert rows(landed.sheet_series(df, 0, 1, 2), "year", "month", "value") == [(2017, 1, 5.5), (2017, 2, 5.7), (2018, 3, 6.0)]


def test_rss(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><description>d</description><pubDate>{}</pubDate></item>"
    text = "<rss><channel>" + item.format("A", "http://a", "Tue, 02 Jan 2024 10:00:00 +0700") + item.format("", "http://b", "x") + item.format("C", "http://c", "x") + "</channel></rss>"
    got = rows(landed.rss_items(spark, put(tmp_path, "r.xml", text)).fillna("", ["title"]), "title", "canonical_url")
    assert got == [("A", "http://a"), ("C", "http://c")]
    when = landed.rss_items(spark, put(tmp_path, "r.xml", text)).filter("title = 'A'").first()["published_at"]
    assert when == dt.datetime(2024, 1, 2, 3)


XBRL = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:i="urn:i" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
<context id="now"><period><instant>2025-12-31</instant></period></context><context id="old"><period><endDate>2024-12-31</endDate></period></context>
<i:TotalAssets contextRef="now" scale="3">1,000</i:TotalAssets><i:TotalAssets contextRef="now">7</i:TotalAssets><i:NetIncome contextRef="now">(125)</i:NetIncome>
<i:Revenue contextRef="old">9</i:Revenue><i:RasioModalInti contextRef="now">0.3125</i:RasioModalInti><i:TotalDebt contextRef="now" xsi:nil="true"/><i:Other contextRef="now">1</i:Other></xbrl>"""


def test_xbrl_and_manifest(spark, tmp_path):
    aliases = landed.fact_aliases(spark, {"RasioModalInti": "capital_adequacy_ratio_reported"})
    got = rows(landed.xbrl_facts(landed.xbrl_listed(spark, put(tmp_path, "x.xml", XBRL)), aliases, "2025-12-31"), "account_code", "value")
    assert got == [("capital_adequacy_ratio_reported", 0.3125), ("net_income", -125.0), ("total_assets", 1000000.0)]
    base = {"ticker": "bbca", "statement_type": "annual", "period_end": "2025-12-31", "published_at": "2026-03-09T08:15:00+07:00", "file": "a/x.xml"}
    filings = [base, base | {"file": "b.xml"}, base | {"file": "../x"}, base | {"published_at": "2026-01-01T00:00:00"}, base | {"statement_type": "weekly"}, base | {"ticker": ""}]
    good, bad = landed.manifest(spark, put(tmp_path, "m.json", json.dumps({"filings": filings})))
    assert rows(good, "ticker", "file", "available_at") == [("BBCA", "b.xml", dt.datetime(2026, 3, 9, 1, 15))] and bad.count() == 4


def test_unreadable_documents_are_rejects(spark, tmp_path):
    put(tmp_path, "x1.xml", XBRL)
    put(tmp_path, "x2.xml", XBRL[:200])
    aliases = landed.fact_aliases(spark)
    listed = landed.xbrl_listed(spark, f"{tmp_path}/x*.xml")
    assert landed.xbrl_facts(listed, aliases, "2025-12-31").select("path").distinct().count() == 1
    assert [r["path"][-6:] for r in landed.xbrl_rejects(listed).collect()] == ["x2.xml"]
    both = landed.xbrl_facts(listed, aliases, "2025-12-31").select("path").unionByName(landed.xbrl_rejects(listed).select("path"))
    assert "binaryFile" not in both._jdf.queryExecution().executedPlan().toString()


def test_facts_by_context_skip_what_is_nil(spark, tmp_path):
    listed = landed.xbrl_listed(spark, put(tmp_path, "x.xml", XBRL))
    assert rows(landed.xbrl_facts(listed, landed.fact_aliases(spark), context="old"), "account_code", "value") == [("revenue", 9.0)]
    assert rows(landed.xbrl_facts(listed, landed.fact_aliases(spark), context="now", multiplier=2.0), "account_code", "value") == [("net_income", -250.0), ("total_assets", 2000000.0)]


def test_request_windows(spark):
    day = lambda x: F.lit(x).cast("date")
    got = spark.range(1).select(landed.request_windows(day("2024-01-01"), day("2024-07-01")).alias("w")).first()["w"]
    assert [(str(w["since"]), str(w["until"])) for w in got] == [("2024-01-01", "2024-03-30"), ("2024-03-31", "2024-06-28"), ("2024-06-29", "2024-07-01")]


def test_wide_statements_and_aliases(spark, tmp_path):
    wide = spark.createDataFrame([(1, "Total Revenue", 5.0, None), (1, "Revenue", 4.0, 3.0), (1, "Junk", 1.0, 1.0)], "company_id long, field string, `2024-12-31` double, `2023-12-31` double")
    fields = spark.createDataFrame([("Total Revenue", "revenue", 1), ("Revenue", "revenue", 2)], "field string, account_code string, priority int")
    assert rows(landed.wide_statements(wide, fields, "annual"), "fiscal_period", "value") == [("2023FY", 3.0), ("2024FY", 5.0)]
    csv = "ticker,previous_ticker,previous_name,effective_from,effective_to,reason\nAAA,OLD,,2020-01-01,,r\nAAA,AAA,,2020-01-01,,r\nZZZ,Q,,2020-01-01,,r\nAAA,,,2020-01-01,,r\nAAA,Q,,2020-01-02,2020-01-01,r\nAAA,Q,,x,,r\n"
    companies = spark.createDataFrame([(1, "AAA", "Name")], "company_id long, ticker string, company_name string")
    good, bad = landed.alias_rows(spark, put(tmp_path, "a.csv", csv), companies)
    assert rows(good, "company_id", "previous_ticker") == [(1, "OLD")] and bad.count() == 5
    points = spark.createDataFrame([("bi_rate", 1.0), ("zzz", 2.0)], "series_code string, value double")
    assert rows(landed.routed_series(points, landed.series_catalog(spark)), "series_code", "table_name") == [("bi_rate", "macro")]


def test_streams(spark, tmp_path):
    shape = "company_id long, trade_date date, open double, high double, low double, close double, volume long"
    day = dt.date(2024, 1, 2)
    spark.createDataFrame([(1, day, 1.0, 2.0, 1.0, 1.5, 5), (1, day, 1.0, 0.5, 1.0, 1.5, 5)], shape).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    jobs.quarantine_stream(stream, f"{tmp_path}/checked", f"{tmp_path}/cp").awaitTermination()
    good, bad = jobs.quarantined(spark, f"{tmp_path}/checked", stream.schema)
    assert good.count() == 1 and bad.first()["raw_row"]["high"] == 0.5
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    for k, batch in enumerate([[(1, t(2, 9), 7, "a", 1.0, ""), (2, t(2, 10), 7, "a", 3.0, "")], [(3, t(2, 11), 7, "a", 2.0, ""), (3, t(2, 11), 7, "a", 2.0, ""), (4, t(4, 9), 7, "a", 9.0, "")]]):
        spark.createDataFrame(batch, jobs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/ev/{k}")
    events = jobs.event_stream(spark, f"{tmp_path}/ev/*", 1)
    bars = jobs.daily_bars(events)
    jobs.upsert_stream(bars, f"{tmp_path}/bars", f"{tmp_path}/cp2").awaitTermination()
    got = rows(jobs.upserted_bars(spark, f"{tmp_path}/bars", bars), "trade_date", "open", "high", "close", "volume")
    assert got == [(dt.date(2024, 1, 2), 1.0, 3.0, 2.0, 4), (dt.date(2024, 1, 4), 9.0, 9.0, 9.0, 1)]
    q = jobs.unique_stream(events, ["event_id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp3").start()
    q.awaitTermination()
    assert pytest.approx(spark.table("once").count()) == 4


def test_stream_query_takes_all_files_in_any_order(spark, tmp_path):
    from tidemark.plans import catalog

    for k in range(20):
        day = F.expr(f"timestamp'2024-01-01' + make_dt_interval(cast((id * 7 + 29 - {k}) % 30 as int))")
        rows = spark.range(k, k + 3).select(F.col("id").alias("event_id"), (F.lit(f"2024-01-{30 - k:02d} 10:00:00").cast("timestamp") if k % 2 else day).alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = catalog.stream_daily_bars(spark, str(tmp_path)).collect()
    want = spark.read.parquet(f"{tmp_path}/events.parquet").groupBy(F.to_date("ts").alias("d")).count().collect()
    assert sorted((r["trade_date"], r["volume"]) for r in got) == sorted(map(tuple, want))


def test_landed_bars_stage_several_companies_in_a_file(spark, monkeypatch):
    from pathlib import Path

    from tidemark.plans import landed as plans

    paths, files = [], plans._files
    monkeypatch.setattr(plans, "_files", lambda *x: paths.append(files(*x)) or paths[-1])
    for name in ("landed_bars", "landed_closes"):
        n = plans.QUERIES[name](spark, "/root/testdata/sf0.001").select("company_id").distinct().count()
        staged = len(list(Path(paths[-1]).rglob("part-*")))
        assert n > 1 and staged <= n // plans.TOGETHER + 1
