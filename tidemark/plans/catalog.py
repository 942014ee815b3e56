"""Registered queries of company selection, merges, attempt log and streams, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalog as c
from tidemark.operators import sinks as s
from tidemark.plans.technical import VALIDATION, broken
from tidemark.sources import landed
from tidemark.sources import projections as p
from tidemark.sources.stored import shared_path
from tidemark.streaming import jobs


def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine active equities evenly spread over ticker order."""
    return c.spread_sample(c.select_companies(p.companies(spark, sf_dir), "%a%"), 9).select("company_id", "ticker")


SPREAD = """
WITH q AS (SELECT *, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM companies WHERE status = 'active' AND asset_type = 'equity' AND sector ILIKE '%a%')
SELECT company_id, ticker FROM q WHERE i IN (SELECT k * n // 9 FROM range(9) r(k))"""


def company_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of companies whose name holds a digit."""
    return c.search_companies(p.companies(spark, sf_dir), "1", "equity", 10, 10).select("ticker", "company_name", "total")


SEARCH = """
WITH q AS (SELECT * FROM companies WHERE (ticker ILIKE '%1%' OR company_name ILIKE '%1%') AND asset_type = 'equity')
SELECT ticker, company_name, (SELECT count(*) FROM q) AS total FROM q ORDER BY ticker LIMIT 10 OFFSET 10"""


_ATTEMPTS = """n AS (SELECT count(*) AS n FROM supplier), a AS (
  SELECT o_orderkey AS id, o_custkey % n.n AS company_id, o_orderdate AS attempted_at,
         CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN 'no data for window' ELSE 'timeout' END AS message,
         CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'no_data' ELSE 'failed' END AS status FROM orders, n)"""


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by status."""
    o = p.table(spark, sf_dir, "orders")
    message = F.when(F.col("o_orderstatus") == "F", F.lit(None)).when(F.col("o_orderstatus") == "O", F.lit("no data for window")).otherwise(F.lit("timeout"))
    rows = o.select(F.col("o_custkey").alias("company_id"), message.alias("message"), F.col("o_orderdate").alias("at"))
    return c.run_totals(c.attempt_log(rows, "prices", F.col("at"))).drop("pipeline_name")


TOTALS = f"WITH {_ATTEMPTS} SELECT status, count(*) AS n FROM a GROUP BY status"


def eligible_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with bars, no annual statement of positive income in 1997, and not cooling down."""
    bars = p.bars(spark, sf_dir).select("company_id")
    done = p.statements(spark, sf_dir).filter("fiscal_period = '1997FY' and net_income > 0")
    o, n = p.table(spark, sf_dir, "orders"), p.table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    wait = F.when(F.col("o_orderstatus") == "O", F.make_dt_interval(F.lit(7))).when(F.col("o_orderstatus") == "P", F.make_dt_interval(F.lit(0), F.lit(1)))
    attempts = o.crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("n")).alias("company_id"), (F.col("o_orderdate") + wait).alias("retry_after"))
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    return c.eligible(p.companies(spark, sf_dir), bars, done, attempts, now).select("company_id", "ticker")


ELIGIBLE = f"""
WITH {_ATTEMPTS}, last AS (SELECT company_id, attempted_at + CASE status WHEN 'no_data' THEN INTERVAL 7 DAY WHEN 'failed' THEN INTERVAL 1 HOUR END AS retry
  FROM a QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id DESC) = 1)
SELECT company_id, ticker FROM companies WHERE company_id IN (SELECT company_id FROM bars)
  AND company_id NOT IN (SELECT company_id FROM statements WHERE fiscal_period = '1997FY' AND net_income > 0)
  AND company_id NOT IN (SELECT company_id FROM last WHERE retry > TIMESTAMP '1996-01-01')"""


def bar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 to SNK3: late line items' bars over early ones, by company and date."""
    # Nearly every line item is a bar: dealt out once for both sides and the upsert, by the size of the table.
    li = p.table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate")).repartition(p.parts_for(spark, sf_dir), "l_suppkey", "l_shipdate")
    side = lambda flag, day: li.filter(F.col("l_linestatus") == flag).groupBy(F.col("l_suppkey").alias("company_id"), F.col("l_shipdate").alias("trade_date")).agg(F.max("l_extendedprice").alias("close")).withColumn("retrieved_at", F.lit(day).cast("date"))
    return s.upsert(side("F", "2002-01-01"), side("O", "2002-01-02"), ["company_id", "trade_date"])


UPSERT = """
SELECT company_id, trade_date, arg_max(close, retrieved_at) AS close, max(retrieved_at) AS retrieved_at
FROM (SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS trade_date, max(l_extendedprice) AS close,
  CASE WHEN l_linestatus = 'F' THEN DATE '2002-01-01' ELSE DATE '2002-01-02' END AS retrieved_at FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), l_linestatus)
GROUP BY company_id, trade_date"""


def article_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: all articles known but those of the last source by name, those of the first and the last arriving: of known
    ones the media name stays and the title changes."""
    a = p.articles(spark, sf_dir).select("canonical_url", "title", "media_name", "article_id")
    ends = F.broadcast(a.agg(F.min("media_name").alias("first"), F.max("media_name").alias("last")))
    both = a.crossJoin(ends)  # with one row
    known = both.filter(~F.col("media_name").eqNullSafe(F.col("last"))).select(*a.columns)
    new = both.filter(F.col("media_name").isin(F.col("first"), F.col("last"))).select(*a.columns)
    return s.upsert_columns(known, new.withColumns({"title": F.concat(F.lit("* "), "title"), "media_name": F.lit("again")}), ["canonical_url"], ["title"])


ARTICLES = """
WITH e AS (SELECT min(media_name) AS a, max(media_name) AS z FROM articles)
SELECT canonical_url, CASE WHEN media_name IN (a, z) THEN '* ' || title ELSE title END AS title,
       CASE WHEN media_name = z THEN 'again' ELSE media_name END AS media_name, article_id FROM articles, e"""


def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """update and backfill starts of each company from its first and last bar."""
    df = p.bars(spark, sf_dir).groupBy("company_id").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    end = F.lit("2008-02-29").cast("date")
    return df.select("company_id", c.backfill_window(F.col("first"), end)[0].alias("backfill_from"), c.update_window(F.col("last"), end)[0].alias("update_from"))


WINDOWS = """
SELECT company_id, greatest(DATE '1998-02-28', min(trade_date)) AS backfill_from, max(trade_date) - 5 AS update_from FROM bars GROUP BY company_id"""


def company_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies known except those of the first industry by name, listed except those of the last, under a new name in
    one sector."""
    df = p.companies(spark, sf_dir)
    df = df.crossJoin(F.broadcast(df.agg(F.min("industry").alias("first"), F.max("industry").alias("last"))))  # with one row
    known = df.filter("industry <> first").select("ticker", "company_name", "asset_type")
    name = F.when(F.col("sector") == "ASIA", F.concat("company_name", F.lit(" Tbk"))).otherwise(F.col("company_name")).alias("company_name")
    return c.sync_companies(known, df.filter("industry <> last").select("ticker", name, "asset_type"))


SYNC = """
WITH e AS (SELECT min(industry) AS a, max(industry) AS z FROM companies)
SELECT ticker, CASE WHEN sector = 'ASIA' AND industry <> z THEN company_name || ' Tbk' ELSE company_name END AS company_name, asset_type,
       CASE WHEN industry = a THEN 'created' WHEN sector = 'ASIA' AND industry <> z THEN 'updated' ELSE 'unchanged' END AS change
FROM companies, e WHERE industry <> a OR industry <> z"""


def close_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC21, J17: the index as a catalogued series, known from the next day."""
    series = landed.close_series(p.index_series(p.bars(spark, sf_dir)).withColumnRenamed("market", "close"), "ihsg_composite")
    df = landed.routed_series(series, landed.series_catalog(spark))
    return df.select("series_code", "observation_date", F.round("value", 4).alias("value"), F.to_date("available_at").alias("available_on"), "unit", "table_name")


SERIES = """
SELECT 'ihsg_composite' AS series_code, trade_date AS observation_date, round(market, 4) AS value, trade_date + 1 AS available_on, 'index_points' AS unit, 'industry' AS table_name FROM index_series"""


def stream_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: all events to daily bars through a stream, upserted into a committed table."""
    path = shared_path(spark, "stream")
    # A pattern, since a stream's path is else taken for a folder.
    bars = jobs.daily_bars(jobs.event_stream(spark, f"{sf_dir}/event[s].parquet", None))
    jobs.upsert_stream(bars, f"{path}/bars", f"{path}/checkpoint").awaitTermination()
    return jobs.upserted_bars(spark, f"{path}/bars", bars)


#: Days from the first event at which the second and the third delivery begin; the days that corrections may be late.
DELIVERIES, DELAY_DAYS = (12, 20), 5


def stream_late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: three deliveries of events in order of time, the later ones with corrections of earlier days.  The stream is
    stopped and started again between them.  A correction counts if its day ended after the watermark, the latest
    time of earlier deliveries less five days; those beyond it are lost, since their state is gone."""
    path = shared_path(spark, "stream")
    events = p.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").withColumn("ts", F.col("ts").cast("timestamp"))
    start = events.agg(F.to_date(F.min("ts"))).first()[0]
    day = F.date_diff(F.to_date("ts"), F.lit(start))
    first, second = (day >= d for d in DELIVERIES)

    def corrected(rows: DataFrame, every: int) -> DataFrame:
        return rows.filter(F.col("event_id") % every == 0).withColumns({"event_id": F.col("event_id") + every * 1_000_000_000_000, "value": F.col("value") * every})

    deliveries = (events.filter(~first), events.filter(first & ~second).unionByName(corrected(events.filter(~first), 7)), events.filter(second).unionByName(corrected(events.filter(~second), 11)))
    for k, rows in enumerate(deliveries):
        rows.write.parquet(f"{path}/events/delivery={k}")
        bars = jobs.daily_bars(jobs.event_stream(spark, f"{path}/events/delivery=*", None), delay=f"{DELAY_DAYS} days")
        jobs.upsert_stream(bars, f"{path}/bars", f"{path}/checkpoint").awaitTermination()
    return jobs.upserted_bars(spark, f"{path}/bars", bars)


LATE = f"""
WITH e AS (SELECT *, date_diff('day', CAST(min(ts) OVER () AS DATE), CAST(ts AS DATE)) AS d FROM events
), w AS (SELECT max(ts) FILTER (d < {DELIVERIES[0]}) - INTERVAL {DELAY_DAYS} DAY AS w1, max(ts) FILTER (d < {DELIVERIES[1]}) - INTERVAL {DELAY_DAYS} DAY AS w2 FROM e
), a AS (
  SELECT event_id, ts, user_id, value FROM e
  UNION ALL SELECT event_id + 7000000000000, ts, user_id, value * 7 FROM e, w WHERE d < {DELIVERIES[0]} AND event_id % 7 = 0 AND CAST(ts AS DATE) + INTERVAL 1 DAY > w1
  UNION ALL SELECT event_id + 11000000000000, ts, user_id, value * 11 FROM e, w WHERE d < {DELIVERIES[1]} AND event_id % 11 = 0 AND CAST(ts AS DATE) + INTERVAL 1 DAY > w2)
SELECT user_id AS company_id, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM a GROUP BY 1, 2"""


def _quarantined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path, bars = shared_path(spark, "stream"), broken(p.bars(spark, sf_dir))
    # Two deliveries, the second to a stream that was stopped.
    for k in range(2):
        bars.filter(F.col("company_id") % 2 == k).write.parquet(f"{path}/bars/delivery={k}")
        stream = spark.readStream.schema(bars.schema).parquet(f"{path}/bars/delivery=*")
        jobs.quarantine_stream(stream, f"{path}/table", f"{path}/checkpoint", F.lit("2001-06-30").cast("date")).awaitTermination()
    return jobs.quarantined(spark, f"{path}/table", bars.schema)


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: arriving bars, broken by rule, to a table of valid bars and one of bad ones with all their errors, under one commit
    for each batch; both tables as rows."""
    valid, bad = _quarantined(spark, sf_dir)
    shown = ["company_id", "trade_date", "close", "volume"]
    good = valid.select(F.lit("valid").alias("part"), *shown, F.lit(0).cast("bigint").alias("n_errors"))
    return good.unionByName(bad.select(F.lit("bad").alias("part"), *(f"raw_row.{c}" for c in shown), F.size("errors").cast("bigint").alias("n_errors")))


QUARANTINED = f"""
WITH v AS ({VALIDATION})
SELECT CASE WHEN n_errors = 0 THEN 'valid' ELSE 'bad' END AS part, company_id, trade_date, CASE WHEN (company_id + day(trade_date)) % 13 = 0 THEN NULL ELSE close END AS close,
       CASE WHEN (company_id + day(trade_date)) % 11 = 0 THEN -volume ELSE volume END AS volume, n_errors
FROM bars JOIN v USING (company_id, trade_date)"""


def stream_unique_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: the days on which each user was seen, from a stream that lets the first event of a user and day through."""
    path = shared_path(spark, "stream")
    events = jobs.event_stream(spark, f"{sf_dir}/event[s].parquet", None).withColumns({"company_id": F.col("user_id"), "trade_date": F.to_date("ts")})
    unique = jobs.unique_stream(events, ["company_id", "trade_date"]).select("company_id", "trade_date")
    sink = unique.writeStream.format("parquet").option("path", f"{path}/days").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(unique.schema).parquet(f"{path}/days")


DAYS = "SELECT DISTINCT user_id AS company_id, CAST(ts AS DATE) AS trade_date FROM events"
STREAM = """
SELECT user_id AS company_id, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""

QUERIES = {
    "spread_sample": spread_sample,
    "company_search": company_search,
    "run_totals": run_totals,
    "eligible_companies": eligible_companies,
    "bar_upsert": bar_upsert,
    "article_upsert": article_upsert,
    "backfill_windows": backfill_windows,
    "company_sync": company_sync,
    "close_series": close_series,
    "stream_daily_bars": stream_daily_bars,
    "stream_late_bars": stream_late_bars,
    "stream_quarantine": stream_quarantine,
    "stream_unique_days": stream_unique_days,
}
ORACLE_SQL = {
    "spread_sample": p.oracle(SPREAD, "companies"),
    "company_search": p.oracle(SEARCH, "companies"),
    "run_totals": TOTALS,
    "eligible_companies": p.oracle(ELIGIBLE, "bars", "companies", "statements"),
    "bar_upsert": UPSERT,
    "article_upsert": p.oracle(ARTICLES, "articles"),
    "backfill_windows": p.oracle(WINDOWS, "bars"),
    "company_sync": p.oracle(SYNC, "companies"),
    "close_series": p.oracle(SERIES, "index_series"),
    "stream_daily_bars": STREAM,
    "stream_late_bars": LATE,
    "stream_quarantine": p.oracle(QUARANTINED, "bars"),
    "stream_unique_days": DAYS,
}
