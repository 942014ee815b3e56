"""Registered queries of merges, listings and logs over the harness tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import catalog as c
from tidemark.operators import sinks as s
from tidemark.sources import landed
from tidemark.sources import projections as p


def listing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, P10, P11: parts as a provider's listing; some types are known ones, some names end in one."""
    kind = F.when(F.col("p_size") % 5 == 0, "Common Stock").when(F.col("p_size") % 5 == 1, " ETF ").when(F.col("p_size") % 5 == 2, "").otherwise(F.col("p_type"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Index"))).otherwise(F.col("p_name"))
    raw = p.table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".JK")).alias("symbol"), name.alias("name"), kind.alias("type"))
    df = landed.listing(raw)
    return df.select("ticker", rules.provider_symbol("yahoo_finance", "ticker").alias("symbol"), rules.asset_type("type", "company_name").alias("asset_type"), rules.usage_restriction(F.lit("yahoo_finance")).alias("usage_restriction"))


LISTING = """
SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_partkey || '.JK' AS symbol,
       CASE WHEN p_size % 5 = 0 THEN 'equity' WHEN p_size % 5 = 1 THEN 'etf' WHEN p_partkey % 3 = 0 THEN 'index' WHEN lower(trim(p_name)) LIKE '% index' THEN 'index'
            WHEN p_size % 5 = 2 THEN 'equity' ELSE 'other' END AS asset_type, 'research_only' AS usage_restriction FROM part WHERE trim(p_name) <> ''"""


def split_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, SNK10: a dividend and a split for each supplier in its first year, upserted over earlier ones of the same provider."""
    b = p.bars(spark, sf_dir).groupBy(F.col("company_id").alias("ticker")).agg(F.min("trade_date").alias("ex_date"))
    ratio = F.when(F.col("ticker") % 3 == 0, 0.25).otherwise((F.col("ticker") % 4 + 2).cast("double"))
    day = lambda x: F.lit(x).cast("date")
    new = landed.corporate_actions(b.withColumn("amount", F.lit(1.5)), b.withColumn("ratio", ratio), day("1995-01-01"), day("2001-12-31")).withColumn("retrieved_at", day("2024-01-02"))
    new = new.withColumn("provider", F.lit("first"))
    old = new.withColumns({"cash_amount": F.lit(1.0), "retrieved_at": day("2024-01-01"), "provider": F.when(F.col("ticker") % 2 == 0, "first").otherwise("second")})
    return s.upsert(old, new, ["ticker", "action_type", "ex_date", "provider"]).select("ticker", "action_type", "ex_date", "provider", "cash_amount", "split_from", "split_to")


ACTIONS = """
WITH b AS (SELECT company_id AS ticker, min(trade_date) AS ex_date FROM bars GROUP BY 1
), a AS (
  SELECT ticker, 'cash_dividend' AS action_type, ex_date, 1.5::DOUBLE AS cash_amount, NULL::DOUBLE AS split_from, NULL::DOUBLE AS split_to FROM b UNION ALL
  SELECT ticker, CASE WHEN ticker % 3 = 0 THEN 'reverse_split' ELSE 'stock_split' END, ex_date, NULL, CASE WHEN ticker % 3 = 0 THEN 4 ELSE 1 END, CASE WHEN ticker % 3 = 0 THEN 1 ELSE ticker % 4 + 2 END FROM b
)
SELECT ticker, action_type, ex_date, 'first' AS provider, cash_amount, split_from, split_to FROM a UNION ALL
SELECT ticker, action_type, ex_date, 'second', 1.0::DOUBLE, split_from, split_to FROM a WHERE ticker % 2 = 1"""


def statement_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: official documents of odd suppliers stay, whatever arrives later; else the newest counts."""
    a = p.statements(spark, sf_dir).filter("statement_type = 'annual'").select("company_id", "fiscal_period", "revenue")
    day = lambda x: F.lit(x).cast("date")
    first = a.withColumns({"source_format": F.when(F.col("company_id") % 2 == 1, "xbrl").otherwise("pdf"), "retrieved_at": day("2024-01-01")})
    later = a.withColumns({"revenue": F.col("revenue") * 2, "source_format": F.lit("pdf"), "retrieved_at": day("2024-02-01")})
    out = s.by_source_priority(first.unionByName(later), ["company_id", "fiscal_period"], F.col("source_format") == "xbrl")
    return out.select("company_id", "fiscal_period", "source_format", F.round("revenue", 2).alias("revenue"))


PRIORITY = """
SELECT company_id, fiscal_period, CASE WHEN company_id % 2 = 1 THEN 'xbrl' ELSE 'pdf' END AS source_format,
       round(CASE WHEN company_id % 2 = 1 THEN revenue ELSE revenue * 2 END, 2) AS revenue FROM statements WHERE statement_type = 'annual'"""


def merged_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual periods of two providers; the first lacks the years that end in 5, and where both have one its own stays."""
    a = p.statements(spark, sf_dir).filter("statement_type = 'annual'").select("company_id", "fiscal_period", "revenue")
    first = a.filter("fiscal_period not like '%5FY'").withColumn("provider", F.lit("first"))
    out = c.merged_periods(first, a.withColumns({"revenue": F.col("revenue") * 2, "provider": F.lit("second")}), ["company_id", "fiscal_period"])
    return out.select("company_id", "fiscal_period", "provider", F.round("revenue", 2).alias("revenue"))


MERGED = """
SELECT company_id, fiscal_period, CASE WHEN fiscal_period LIKE '%5FY' THEN 'second' ELSE 'first' END AS provider,
       round(CASE WHEN fiscal_period LIKE '%5FY' THEN revenue * 2 ELSE revenue END, 2) AS revenue FROM statements WHERE statement_type = 'annual'"""


def snapshot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, SNK6: today's rows of every third supplier replaced, other days and suppliers untouched."""
    sup = p.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_acctbal").alias("value"))
    day = lambda x: F.lit(x).cast("date")
    old = sup.withColumn("as_of_date", day("2024-01-01")).unionByName(sup.withColumn("as_of_date", day("2024-01-02")))
    new = sup.filter("company_id % 3 = 0").withColumns({"as_of_date": day("2024-01-02"), "value": -F.col("value")})
    return s.replace_snapshot(old, new)


REPLACE = """
SELECT s_suppkey AS company_id, DATE '2024-01-01' AS as_of_date, s_acctbal AS value FROM supplier UNION ALL
SELECT s_suppkey, DATE '2024-01-02', CASE WHEN s_suppkey % 3 = 0 THEN -s_acctbal ELSE s_acctbal END FROM supplier"""


def absent_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: articles scored once; only unscored ones are added."""
    a = p.articles(spark, sf_dir).select("article_id", "media_name")
    old = a.filter("article_id % 4 = 0").withColumn("score", F.lit(1))
    return s.append_absent(old, a.withColumn("score", F.lit(2)), ["article_id"])


ABSENT = "SELECT article_id, media_name, CAST(CASE WHEN article_id % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS score FROM articles"


def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed orders by priority as pipelines: how many, and the first message."""
    o = p.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    log = o.select(F.col("o_orderpriority").alias("pipeline_name"), F.lit("failed").alias("status"), F.col("o_orderdate").alias("attempted_at"), F.col("o_orderkey").alias("company_id"), F.lit("timeout").alias("message"))
    out = c.failure_summary(log)
    return out.select("pipeline_name", "failures", F.size("first").cast("bigint").alias("shown"), F.col("first")[0].alias("first_message"))


FAILURES = """
SELECT o_orderpriority AS pipeline_name, count(*) AS failures, least(20, count(*)) AS shown, first(o_orderkey || ': timeout' ORDER BY o_orderdate, o_orderkey) AS first_message
FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"""


def reconciled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars marked where a second price exists; every provider's row of that date."""
    li = p.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    side = lambda f: F.max(F.when(F.col("l_returnflag") == f, price))
    sources = F.array_sort(F.collect_set("l_returnflag")).alias("sources")
    days = li.groupBy(F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").alias("trade_date")).agg(side("A").alias("x"), side("R").alias("y"), sources)
    checked = days.select("company_id", "trade_date", F.explode("sources").alias("source"), rules.reconciliation("x", "y", 20.0)[0].alias("status"))
    return checked.select("company_id", "trade_date", "source", s.reconciled_status("status", F.lit("raw")).alias("quality_status"))


RECONCILED = """
WITH s AS (SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS trade_date, l_returnflag AS source,
  max(max(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag = 'A')) OVER w AS a, max(max(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag = 'R')) OVER w AS r
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), l_returnflag WINDOW w AS (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)))
SELECT company_id, trade_date, source, CASE WHEN a IS NULL OR r IS NULL THEN 'raw' WHEN abs(a - r) / a * 100 <= 20 THEN 'reconciled_matched' ELSE 'reconciled_mismatch' END AS quality_status
FROM s"""


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensed articles with their availability: publication, or a fixed moment where unknown."""
    a = p.articles(spark, sf_dir).withColumns(
        {"usage_restriction": F.when(F.col("article_id") % 5 == 0, "research_only"), "published_at": F.when(F.col("article_id") % 7 != 0, F.col("published_at"))}
    )
    known = F.coalesce("published_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return c.licensed_feeds(a, production=True).select("article_id", "media_name", known.alias("available_at"))


ROWS = """
SELECT article_id, media_name, CASE WHEN article_id % 7 <> 0 THEN published_at ELSE TIMESTAMP '2024-01-01 00:00:00' END AS available_at
FROM articles WHERE article_id % 5 <> 0"""

QUERIES = {
    "listing_types": listing_types,
    "split_actions": split_actions,
    "statement_priority": statement_priority,
    "merged_statements": merged_statements,
    "snapshot_replace": snapshot_replace,
    "absent_only": absent_only,
    "failure_summary": failure_summary,
    "reconciled_bars": reconciled_bars,
    "article_rows": article_rows,
}
ORACLE_SQL = {
    "listing_types": LISTING,
    "split_actions": p.oracle(ACTIONS, "bars"),
    "statement_priority": p.oracle(PRIORITY, "statements"),
    "merged_statements": p.oracle(MERGED, "statements"),
    "snapshot_replace": REPLACE,
    "absent_only": p.oracle(ABSENT, "articles"),
    "failure_summary": FAILURES,
    "reconciled_bars": RECONCILED,
    "article_rows": p.oracle(ROWS, "articles"),
}
