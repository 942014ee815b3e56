"""Statement items to ratios, and ratios to sector percentiles and disclosed industry metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import percentile_midpoint
from tidemark.functions.rules import formula_route, ratio_percent, reported_percent, safe_div
from tidemark.operators.asof import asof_join, latest_by
from tidemark.sources.taxonomy import ACCOUNT_CODES, CORE_CODES

STATEMENT = ["company_id", "statement_type", "fiscal_period", "period_end", "available_at"]
#: Numerator and denominator of each ratio.
RATIOS = {
    "gross_margin": ("gross_profit", "revenue"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "roe": ("net_income", "total_equity"),
    "roa": ("net_income", "total_assets"),
    "debt_to_equity": ("total_debt", "total_equity"),
    "debt_to_assets": ("total_debt", "total_assets"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "fcf_margin": ("free_cash_flow", "revenue"),
    "ocf_margin": ("operating_cash_flow", "revenue"),
    "book_value_per_share": ("total_equity", "shares_outstanding"),
}
PRICE_RATIOS = ("price_to_earnings", "price_to_book")
SECTOR_RATIOS = ("net_margin", "roe", "debt_to_equity")
LEAST_COMPLETE = 0.2


def wide_items(items: DataFrame) -> DataFrame:
    """One row for each statement with a column for each known account code: one aggregation, which holds a statement, not an item."""
    return items.groupBy(*STATEMENT).agg(*(F.max(F.when(F.col("account_code") == c, F.col("value"))).alias(c) for c in ACCOUNT_CODES))


def completeness(items: DataFrame) -> DataFrame:
    """(statement, completeness, quality_status): core codes present of all core codes; too few are
    marked insufficient and kept."""
    # A bit for each core code: distinct codes are counted without a row for each in memory.
    bits = F.create_map(*(F.lit(x) for i, c in enumerate(CORE_CODES) for x in (c, 1 << i)))
    seen = F.bit_or(F.when(F.col("value").isNotNull(), bits[F.col("account_code")].cast("bigint")))
    share = F.bit_count(F.coalesce(seen, F.lit(0))) / len(CORE_CODES)
    return items.groupBy(*STATEMENT).agg(share.alias("completeness")).withColumn(
        "quality_status", F.when(F.col("completeness") < LEAST_COMPLETE, "data_tidak_mencukupi").otherwise("valid")
    )


def usable_items(items: DataFrame) -> DataFrame:
    """The items of statements that are complete enough to count."""
    thin = completeness(items).filter(F.col("completeness") < LEAST_COMPLETE).select(*STATEMENT)
    return items.join(thin, STATEMENT, "left_anti").select(*items.columns)


def ratios(items: DataFrame, prices: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each statement and ratio: (statement columns, ratio_name, value, is_applicable).

    ``parts`` deals both sides out by company into so many partitions; rows that come so dealt out need none.

    The price is the last known close at or before the statement became available.  A ratio that
    cannot be computed keeps its row, not applicable.  Statements with too few core items are left out
    by ``usable_items`` before.
    """
    closes = prices.filter("close is not null").select("company_id", "trade_date", "close")
    codes = sorted({c for pair in RATIOS.values() for c in pair} | {"eps_diluted", "eps_basic"})
    wide = wide_items(items).select(*STATEMENT, *codes)
    if parts:
        wide, closes = wide.repartition(parts, "company_id"), closes.repartition(parts, "company_id")
    wide = asof_join(wide, closes, "company_id", "available_at", "trade_date")
    eps = F.coalesce("eps_diluted", "eps_basic")
    made = {n: safe_div(a, b) for n, (a, b) in RATIOS.items()}
    made["price_to_earnings"] = F.when(eps > 0, safe_div("close", eps))
    made["price_to_book"] = safe_div("close", safe_div("total_equity", "shares_outstanding"))
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("ratio"), v.alias("value")) for n, v in made.items())))
    return (
        wide.select(*STATEMENT, each)
        .withColumn("ratio_name", F.concat_ws("__", "ratio", "statement_type"))
        .withColumn("is_applicable", F.col("value").isNotNull())
        .drop("ratio")
    )


def latest_ratios(ratios: DataFrame, as_of=None) -> DataFrame:
    """(company_id, ratio, value): the newest applicable value of each ratio, annual or quarterly."""
    usable = ratios.filter("is_applicable")
    if as_of is not None:
        usable = usable.filter(F.col("available_at") <= as_of)
    plain = usable.withColumn("ratio", F.regexp_replace("ratio_name", "__[^_]+$", ""))
    return latest_by(plain.select("company_id", "ratio", "value", "available_at", "period_end", "ratio_name"), ["company_id", "ratio"], ["available_at", "period_end", "ratio_name"]).select("company_id", "ratio", "value")


def sector_percentiles(ratios: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_id, metric_name, value): where a company's ratio stands among its sector's equities; three peers at least."""
    peers = companies.filter("asset_type = 'equity' and sector is not null").select("company_id", "sector")
    known = latest_ratios(ratios).filter(F.col("ratio").isin(*SECTOR_RATIOS)).join(peers, "company_id")
    ranked = known.withColumn("percentile", percentile_midpoint("value", "sector", "ratio"))
    return ranked.filter("percentile is not null").select("company_id", F.concat("ratio", F.lit("_percentile_in_sector")).alias("metric_name"), F.col("percentile").alias("value"))


def bank_metrics(wide: DataFrame) -> DataFrame:
    """Bank columns from current items and, as previous_earning_assets, the earlier statement's."""
    average = (F.col("earning_assets") + F.col("previous_earning_assets")) / 2
    derived_nim = F.when(F.col("statement_type") == "annual", ratio_percent("net_interest_income", average))
    return wide.withColumns(
        {
            "npl_gross_pct": F.coalesce(reported_percent("npl_gross_ratio_reported"), ratio_percent("non_performing_loans_gross", "gross_loans")),
            "npl_net_pct": F.coalesce(reported_percent("npl_net_ratio_reported"), ratio_percent("non_performing_loans_net", "gross_loans")),
            "net_interest_margin_pct": F.coalesce(reported_percent("net_interest_margin_reported"), derived_nim),
            "capital_adequacy_ratio_pct": F.coalesce(reported_percent("capital_adequacy_ratio_reported"), ratio_percent("regulatory_capital", "risk_weighted_assets")),
            "loan_to_deposit_ratio_pct": ratio_percent("gross_loans", "customer_deposits"),
            "casa_ratio_pct": ratio_percent(F.col("current_accounts") + F.col("savings_accounts"), "customer_deposits"),
        }
    )


def mining_metrics(wide: DataFrame) -> DataFrame:
    """Mining columns; reserve life only where both quantities are in one known unit and something is produced."""
    reserves, production = F.col("proven_probable_reserves"), F.col("annual_production")
    unit = F.col("unit_proven_probable_reserves")
    same_unit = (unit != "") & (unit == F.col("unit_annual_production"))
    life = F.when(same_unit & (reserves >= 0) & (production > 0), reserves / production)
    return wide.withColumns({"reserve_life_years": life, "cash_cost_per_unit": F.col("cash_cost_per_unit_reported"), "stripping_ratio": F.col("stripping_ratio_reported")})


#: The disclosed facts that bear on each route.
RELEVANT = {
    "bank": (
        "gross_loans", "non_performing_loans_gross", "non_performing_loans_net", "earning_assets", "regulatory_capital", "risk_weighted_assets",
        "customer_deposits", "current_accounts", "savings_accounts", "npl_gross_ratio_reported", "npl_net_ratio_reported",
        "net_interest_margin_reported", "capital_adequacy_ratio_reported",
    ),
    "mining": ("proven_probable_reserves", "annual_production", "cash_cost_per_unit_reported", "stripping_ratio_reported"),
}
#: The fact whose unit a mining metric carries, and the unit where none is known.
UNITS = {
    "cash_cost_per_unit": ("cash_cost_per_unit_reported", "unit"),
    "stripping_ratio": ("stripping_ratio_reported", "ratio"),
    "proven_probable_reserves": ("proven_probable_reserves", "unit"),
    "annual_production": ("annual_production", "unit"),
}
_BANK = ("npl_gross_pct", "npl_net_pct", "net_interest_margin_pct", "capital_adequacy_ratio_pct", "loan_to_deposit_ratio_pct", "casa_ratio_pct")
_MINING = ("reserve_life_years", "cash_cost_per_unit", "stripping_ratio", "proven_probable_reserves", "annual_production")


def disclosed_metrics(items: DataFrame, companies: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(company_id, route, metric_name, value, unit): bank or mining metrics of the newest statement that holds a
    relevant fact; the newest earlier one of the same type gives previous values.

    ``units`` (statement columns, account_code, unit) names the units of facts; without them no reserve life is
    known, since that needs both quantities in one unit.
    """
    routed = companies.select("company_id", formula_route("sector", "industry").alias("route")).filter("route is not null")
    df = items.join(routed, "company_id")
    holds = (F.col("route") == "bank") & F.col("account_code").isin(*RELEVANT["bank"]) | (F.col("route") == "mining") & F.col("account_code").isin(*RELEVANT["mining"])
    facts = df.filter(holds).select(*STATEMENT).distinct()
    newest = Window.partitionBy("company_id").orderBy(F.desc("available_at"), F.desc("period_end"), "statement_type")
    current = facts.withColumn("k", F.row_number().over(newest)).filter("k = 1").drop("k")
    earlier = (
        facts.alias("f")
        .join(current.alias("c"), "company_id")
        .filter("f.statement_type = c.statement_type and f.period_end < c.period_end")
        .select("f.*")
    )
    previous = latest_by(earlier, ["company_id"], ["available_at", "period_end"]).select("company_id", "statement_type", "fiscal_period", "period_end", "available_at")
    wide = wide_items(df.select(*STATEMENT, "account_code", "value"))
    before = wide.join(previous, STATEMENT, "left_semi").select("company_id", F.col("earning_assets").alias("previous_earning_assets"))
    now = wide.join(current, STATEMENT, "left_semi").join(before, "company_id", "left").join(routed, "company_id")
    facts = [fact for fact, _ in UNITS.values()]
    if units is None:
        now = now.withColumns({f"unit_{c}": F.lit(None).cast("string") for c in facts})
    else:
        known = units.groupBy(*STATEMENT).agg(*(F.max(F.when(F.col("account_code") == c, F.col("unit"))).alias(f"unit_{c}") for c in facts))
        now = now.join(known, STATEMENT, "left")
    full = mining_metrics(bank_metrics(now))
    named = [f"unit_{c}" for c in facts]
    long = full.unpivot(["company_id", "route", *named], [*_BANK, *_MINING], "metric_name", "value").filter("value is not null")
    own = (F.col("route") == "bank") & F.col("metric_name").isin(*_BANK) | (F.col("route") == "mining") & F.col("metric_name").isin(*_MINING)
    unit = F.when(F.col("metric_name") == "reserve_life_years", "years")
    for metric, (fact, default) in UNITS.items():
        unit = unit.when(F.col("metric_name") == metric, F.coalesce(F.nullif(f"unit_{fact}", F.lit("")), F.lit(default)))
    return long.filter(own).withColumn("unit", unit.otherwise("percent")).drop(*named)
