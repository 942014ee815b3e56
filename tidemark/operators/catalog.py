"""Company master, batch selection and attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync_companies(known: DataFrame, listed: DataFrame) -> DataFrame:
    """The company master after a listing: new tickers added, names and types updated, nothing deleted.
    Column change says created, updated or unchanged."""
    k, n = known.alias("k"), listed.dropDuplicates(["ticker"]).alias("n")
    df = k.join(n, F.col("k.ticker") == F.col("n.ticker"), "full")
    differs = (F.col("n.company_name").isNotNull() & ~F.col("k.company_name").eqNullSafe(F.col("n.company_name"))) | (
        F.col("n.asset_type").isNotNull() & ~F.col("k.asset_type").eqNullSafe(F.col("n.asset_type"))
    )
    change = F.when(F.col("k.ticker").isNull(), "created").when(differs, "updated").otherwise("unchanged")
    new = {c: F.coalesce(f"n.{c}", f"k.{c}").alias(c) for c in ("ticker", "company_name", "asset_type")}
    rest = [F.col(f"k.{c}").alias(c) for c in known.columns if c not in new]
    return df.select(*new.values(), *rest, change.alias("change"))


def select_companies(companies: DataFrame, sector: str | None = None) -> DataFrame:
    """Active equities, of a sector pattern if given, by ticker."""
    df = companies.filter("status = 'active' and asset_type = 'equity'")
    return (df.filter(F.col("sector").ilike(sector)) if sector else df).orderBy("ticker")


def search_companies(companies: DataFrame, q: str | None = None, asset_type: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of companies whose ticker or name holds ``q``, with the total."""
    df = companies
    if q:
        df = df.filter(F.col("ticker").ilike(f"%{q}%") | F.col("company_name").ilike(f"%{q}%"))
    if asset_type:
        df = df.filter(F.col("asset_type") == asset_type)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy("ticker").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def spread_sample(companies: DataFrame, n: int) -> DataFrame:
    """``n`` companies evenly spread over ticker order: those at index floor(i * count / n).

    The order is global but light: row numbers come from counts of ticker ranges, not from one task.
    """
    total = companies.count()
    wanted = sorted({i * total // n for i in range(n)} if total else set())
    ranged = companies.repartitionByRange("ticker").sortWithinPartitions("ticker").withColumn("__part", F.spark_partition_id()).persist()
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, {}
    for part in sorted(counts):
        starts[part] = before
        before += counts[part]
    first = F.create_map(*(F.lit(x) for kv in (starts or {0: 0}).items() for x in kv))[F.col("__part")]
    w = Window.partitionBy("__part").orderBy("ticker")
    index = first + F.row_number().over(w) - 1
    return ranged.withColumn("__i", index).filter(F.col("__i").isin(wanted)).drop("__i", "__part")


def eligible(companies: DataFrame, prerequisite: DataFrame | None = None, done: DataFrame | None = None, attempts: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Companies that have the prerequisite rows, lack output and are not cooling down; filtered before any limit."""
    df = companies
    if prerequisite is not None:
        df = df.join(prerequisite.select("company_id").distinct(), "company_id", "left_semi")
    if done is not None:
        df = df.join(done.select("company_id").distinct(), "company_id", "left_anti")
    if attempts is not None:
        last = attempts.groupBy("company_id").agg(F.max_by("retry_after", "id").alias("retry_after"))
        df = df.join(last.filter(F.col("retry_after") > now).select("company_id"), "company_id", "left_anti")
    return df


def attempt_log(results: DataFrame, pipeline: str, at: Column) -> DataFrame:
    """Results (company_id, message) as attempts: no_data may be tried again after 7 days, a failure after an
    hour, a success at any time."""
    said = F.lower(F.coalesce("message", F.lit("")))
    status = F.when(F.col("message").isNull(), "succeeded").when(said.startswith("no data") | said.startswith("skipped"), "no_data").otherwise("failed")
    wait = F.when(F.col("status") == "no_data", F.make_dt_interval(F.lit(7))).when(F.col("status") == "failed", F.make_dt_interval(F.lit(0), F.lit(1)))
    return results.select("company_id", F.lit(pipeline).alias("pipeline_name"), status.alias("status"), at.alias("attempted_at"), "message").withColumn("retry_after", F.col("attempted_at") + wait)


def run_totals(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("pipeline_name", "status").agg(F.count("*").alias("n"))


def failure_summary(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """(pipeline_name, failures, first ``limit`` messages): the rest only counted."""
    failed = attempts.filter("status = 'failed'")
    w = Window.partitionBy("pipeline_name").orderBy("attempted_at", "company_id")
    ranked = failed.withColumn("__k", F.row_number().over(w))
    said = F.sort_array(F.collect_list(F.when(F.col("__k") <= limit, F.struct("__k", F.concat_ws(": ", "company_id", "message").alias("m")))))
    return ranked.groupBy("pipeline_name").agg(F.count("*").alias("failures"), F.transform(said, lambda x: x["m"]).alias("first"))


def backfill_window(listing: Column, end: Column) -> tuple[Column, Column]:
    """From ten years before ``end`` or the listing, whichever is later."""
    return F.greatest(F.add_months(end, -120), listing), end


def update_window(last: Column, end: Column, overlap: int = 5) -> tuple[Column, Column]:
    """From a few days before the last bar, so that late corrections are read again."""
    return F.date_sub(last, overlap), end


def merged_periods(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Periods of both providers; where both have one the primary's stays."""
    both = primary.withColumn("__p", F.lit(0)).unionByName(secondary.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__p"))).filter("__k = 1").drop("__k", "__p")


def licensed_feeds(feeds: DataFrame, production: bool) -> DataFrame:
    return feeds.filter(F.col("usage_restriction").isNull()) if production else feeds
