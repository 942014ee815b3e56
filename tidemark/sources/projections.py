"""The harness tables in the shapes of the domain: bars, companies, statements, items, articles.

``SQL`` holds one text for each shape, valid in Spark SQL and in the oracle's dialect alike, so that a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"

#: Oracle text of each shape; names of other shapes inside are resolved by ``oracle``.
SQL = {
    "bars": f"""
SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS trade_date,
       first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
       last(l_extendedprice / l_quantity ORDER BY {_ORDER}) * (1 - max(l_discount)) AS adjusted_close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2""",
    "index_series": "SELECT trade_date, avg(close) AS market FROM bars GROUP BY 1",
    "companies": """
SELECT s_suppkey AS company_id, s_name AS ticker, s_name AS company_name, r_name AS sector, n_name AS industry,
       CASE WHEN s_suppkey % 11 = 0 THEN 'index' ELSE 'equity' END AS asset_type,
       CASE WHEN s_suppkey % 13 = 0 THEN 'suspended' ELSE 'active' END AS status,
       1000000 + s_suppkey * 1000 AS shares_outstanding
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "statements": """
SELECT company_id, statement_type, fiscal_period, period_end,
       period_end + CAST(lag_days AS INTEGER) AS available_at, revenue, gross_profit, net_income, total_debt
FROM (
  SELECT l_suppkey AS company_id, 'annual' AS statement_type, 120 AS lag_days,
         concat(CAST(year(l_shipdate) AS VARCHAR(4)), 'FY') AS fiscal_period,
         make_date(CAST(year(l_shipdate) AS INT), 12, 31) AS period_end,
         sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) * 0.3 AS gross_profit,
         sum(l_extendedprice * (0.05 - l_discount)) AS net_income, sum(l_extendedprice * l_tax) AS total_debt
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
  UNION ALL
  SELECT l_suppkey, 'quarterly', 60,
         concat(CAST(year(l_shipdate) AS VARCHAR(4)), 'Q', CAST(quarter(l_shipdate) AS VARCHAR(1))),
         last_day(make_date(CAST(year(l_shipdate) AS INT), CAST(3 * quarter(l_shipdate) AS INT), 1)),
         sum(l_extendedprice), sum(l_extendedprice * (1 - l_discount)) * 0.3,
         sum(l_extendedprice * (0.05 - l_discount)), sum(l_extendedprice * l_tax)
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)
) s""",
    "items": """
SELECT company_id, statement_type, fiscal_period, period_end, available_at, account_code, value FROM (
  SELECT s.*, c.s_acctbal, c.s_nationkey, k.account_code,
         CASE k.account_code
           WHEN 'revenue' THEN revenue WHEN 'gross_profit' THEN gross_profit WHEN 'operating_income' THEN gross_profit * 0.6
           WHEN 'net_income' THEN net_income WHEN 'total_equity' THEN c.s_acctbal * 1000
           WHEN 'total_assets' THEN c.s_acctbal * 1000 + total_debt WHEN 'total_debt' THEN total_debt
           WHEN 'current_assets' THEN CASE WHEN c.s_nationkey % 5 = 0 THEN NULL ELSE revenue * 0.4 END
           WHEN 'current_liabilities' THEN revenue * 0.2 WHEN 'operating_cash_flow' THEN gross_profit * 0.5
           WHEN 'free_cash_flow' THEN gross_profit * 0.5 - total_debt WHEN 'cash_and_equivalents' THEN revenue * 0.05
           WHEN 'eps_basic' THEN net_income / (1000000 + company_id * 1000)
           WHEN 'shares_outstanding' THEN 1000000.0 + company_id * 1000 END AS value
  FROM statements s JOIN supplier c ON c.s_suppkey = s.company_id
  CROSS JOIN (SELECT unnest(['revenue', 'gross_profit', 'operating_income', 'net_income', 'total_equity', 'total_assets',
    'total_debt', 'current_assets', 'current_liabilities', 'operating_cash_flow', 'free_cash_flow',
    'cash_and_equivalents', 'eps_basic', 'shares_outstanding']) AS account_code) k
) i WHERE value IS NOT NULL""",
    "articles": """
SELECT doc_id AS article_id, concat('https://news.example/', CAST(doc_id AS VARCHAR(20))) AS canonical_url,
       substr(text, 1, 80) AS title, text AS summary, source AS media_name,
       TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS published_at
FROM documents""",
}

_NEEDS = {"index_series": ["bars"], "items": ["statements"]}

#: Account codes that the projected items use.
CODES = (
    "revenue", "gross_profit", "operating_income", "net_income", "total_equity", "total_assets", "total_debt", "current_assets",
    "current_liabilities", "operating_cash_flow", "free_cash_flow", "cash_and_equivalents", "eps_basic", "shares_outstanding",
)


def oracle(query: str, *shapes: str) -> str:
    """Oracle SQL of a query over projected shapes, with what those need."""
    wanted: list[str] = []
    for s in shapes:
        wanted += [n for n in [*_NEEDS.get(s, []), s] if n not in wanted]
    head, rest = ("WITH RECURSIVE ", query.lstrip()[len("WITH ") :]) if query.lstrip().startswith("WITH ") else ("WITH ", "")
    made = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"{head}{made}" + (f",\n{rest}" if rest else f"\n{query}")


#: Rows of a base table that a task gets at most, on average, where a query deals them out itself.
ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """Partitions for what is made of a base table's rows: the session's number, or more as the table grows, so that a task's memory
    does not grow with it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // ROWS))


def bars(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Daily bars: one supplier's line items of one ship date.

    With ``parts`` line items are dealt out by company first: nearly every one is a bar of its own, so partial results would save
    nothing, and windows and as-of joins by company find their rows together.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem")
    return (
        (li.repartition(parts, "l_suppkey") if parts else li)
        .groupBy(F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").alias("trade_date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            (F.max_by(price, order) * (1 - F.max("l_discount"))).alias("adjusted_close"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
    )


def index_series(bars: DataFrame) -> DataFrame:
    """Mean close of all companies on each date, as the market index."""
    return bars.groupBy("trade_date").agg(F.avg("close").alias("market"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("company_id"),
            F.col("s_name").alias("ticker"),
            F.col("s_name").alias("company_name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.when(key % 11 == 0, "index").otherwise("equity").alias("asset_type"),
            F.when(key % 13 == 0, "suspended").otherwise("active").alias("status"),
            (1_000_000 + key * 1000).alias("shares_outstanding"),
        )
    )


def statements(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One annual and one quarterly statement for each supplier and period, with the sums they hold.

    Line items are dealt out by company first, into ``parts`` or partitions by the table's size: partial results before that would
    hold nearly every statement of the table in each task.
    """
    li = table(spark, sf_dir, "lineitem").repartition(parts or parts_for(spark, sf_dir), "l_suppkey")
    li = li.withColumns({"y": F.year("l_shipdate"), "q": F.quarter("l_shipdate")})
    price = F.col("l_extendedprice")

    def sums(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy("l_suppkey", *keys).agg(
            F.sum(price).alias("revenue"),
            (F.sum(price * (1 - F.col("l_discount"))) * 0.3).alias("gross_profit"),
            F.sum(price * (0.05 - F.col("l_discount"))).alias("net_income"),
            F.sum(price * F.col("l_tax")).alias("total_debt"),
        )

    from tidemark.functions.rules import available_date, fiscal_period

    annual = sums(li, "y").withColumns({"statement_type": F.lit("annual"), "period_end": F.make_date("y", F.lit(12), F.lit(31))})
    quarterly = sums(li, "y", "q").withColumns(
        {"statement_type": F.lit("quarterly"), "period_end": F.last_day(F.make_date("y", 3 * F.col("q"), F.lit(1)))}
    )
    both = annual.drop("y").unionByName(quarterly.drop("y", "q"))
    return both.select(
        F.col("l_suppkey").alias("company_id"),
        "statement_type",
        fiscal_period("period_end", "statement_type").alias("fiscal_period"),
        "period_end",
        available_date("period_end", "statement_type").alias("available_at"),
        "revenue",
        "gross_profit",
        "net_income",
        "total_debt",
    )


def items(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Statement items, one row for each (statement, account code) that has a value; dealt out by company, as statements are."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), "s_acctbal", "s_nationkey")
    s = statements(spark, sf_dir, parts).join(suppliers, "company_id")
    shares = (1_000_000 + F.col("company_id") * 1000).cast("double")
    equity, revenue, gross = F.col("s_acctbal") * 1000, F.col("revenue"), F.col("gross_profit")
    values = {
        "revenue": revenue,
        "gross_profit": gross,
        "operating_income": gross * 0.6,
        "net_income": F.col("net_income"),
        "total_equity": equity,
        "total_assets": equity + F.col("total_debt"),
        "total_debt": F.col("total_debt"),
        "current_assets": F.when(F.col("s_nationkey") % 5 != 0, revenue * 0.4),
        "current_liabilities": revenue * 0.2,
        "operating_cash_flow": gross * 0.5,
        "free_cash_flow": gross * 0.5 - F.col("total_debt"),
        "cash_and_equivalents": revenue * 0.05,
        "eps_basic": F.col("net_income") / shares,
        "shares_outstanding": shares,
    }
    keys = ["company_id", "statement_type", "fiscal_period", "period_end", "available_at"]
    # Exploded, since rows stay where they are dealt to; after an unpivot Spark does not know that.
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("account_code"), values[c].alias("value")) for c in CODES)))
    return s.select(*keys, each).filter("value is not null")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("summary"),
        F.col("source").alias("media_name"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("published_at"),
    )
