"""Registered queries of ratios, sectors, valuation and recommendation, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import reconciliation, sector_code
from tidemark.operators import fundamentals as f
from tidemark.operators import valuation as v
from tidemark.operators.asof import asof_join, latest_by, value_at
from tidemark.operators.technical import FEATURES
from tidemark.plans.news import SENTIMENT, sentiment_by_company
from tidemark.plans.technical import long_rows, newest_features
from tidemark.sources import projections as p
from tidemark.sources.stored import stored

AS_OF = "1999-06-30"
ASSUMED = v.Assumptions(0.12, 0.06, 0.03, 5)
STATEMENT = f.STATEMENT
_KEYS = ", ".join(STATEMENT)


def _as_of():
    return F.lit(AS_OF).cast("date")


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = p.parts_for(spark, sf_dir)
    return f.ratios(p.items(spark, sf_dir, parts), p.bars(spark, sf_dir, parts))


def statement_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, J3, F3 to F5."""
    value = F.when(F.abs("value") > 1e4, F.round("value", 1)).otherwise(F.round("value", 6))
    return _ratios(spark, sf_dir).select(*STATEMENT, "ratio_name", value.alias("value"), "is_applicable")


_CODES = ", ".join(f"max(CASE WHEN account_code = '{c}' THEN value END) AS {c}" for c in p.CODES)
_WIDE = f"wide AS (SELECT {_KEYS}, {_CODES} FROM items GROUP BY {_KEYS})"
_VALUES = {n: f"{a} / nullif({b}, 0)" for n, (a, b) in f.RATIOS.items()}
_VALUES["price_to_earnings"] = "CASE WHEN eps_basic > 0 THEN close / eps_basic END"
_VALUES["price_to_book"] = "close / nullif(total_equity / nullif(shares_outstanding, 0), 0)"
_UNION = " UNION ALL ".join(f"SELECT {_KEYS}, '{n}' AS ratio, {e} AS value FROM priced" for n, e in _VALUES.items())
#: CTEs ending in ratios(statement keys, ratio, value, ratio_name, is_applicable).
_RATIOS = f"""
{_WIDE}, priced AS (SELECT wide.*, b.close FROM wide ASOF LEFT JOIN bars b ON b.company_id = wide.company_id AND wide.available_at >= b.trade_date
), ratios AS (SELECT *, ratio || '__' || statement_type AS ratio_name, value IS NOT NULL AS is_applicable FROM ({_UNION}))"""
RATIOS_SQL, RATIO_NAMES = _RATIOS, tuple(_VALUES)
STATEMENT_RATIOS = f"WITH {_RATIOS} SELECT {_KEYS}, ratio_name, CASE WHEN abs(value) > 1e4 THEN round(value, 1) ELSE round(value, 6) END AS value, is_applicable FROM ratios"


def statement_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return f.completeness(p.items(spark, sf_dir, p.parts_for(spark, sf_dir))).withColumn("completeness", F.round("completeness", 6))


_CORE = ", ".join(f"'{c}'" for c in f.CORE_CODES)
COMPLETENESS = f"""
SELECT {_KEYS}, round(count(DISTINCT account_code) FILTER (account_code IN ({_CORE})) / 30, 6) AS completeness,
       CASE WHEN count(DISTINCT account_code) FILTER (account_code IN ({_CORE})) / 30 < 0.2 THEN 'data_tidak_mencukupi' ELSE 'valid' END AS quality_status
FROM items GROUP BY {_KEYS}"""


def thin_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """even companies tell a diluted EPS, which comes before the basic one; quarterly statements of every fifth
    company hold two items and count neither for ratios nor for the latest EPS."""
    items = p.items(spark, sf_dir)
    diluted = items.filter("account_code = 'eps_basic' and company_id % 2 = 0").withColumns({"account_code": F.lit("eps_diluted"), "value": F.col("value") * 0.9})
    few = (F.col("company_id") % 5 != 0) | (F.col("statement_type") == "annual") | F.col("account_code").isin("revenue", "net_income", "eps_diluted")
    items = stored(items.unionByName(diluted).filter(few), "items")
    parts = p.parts_for(spark, sf_dir)
    usable = stored(f.usable_items(items.repartition(parts, *STATEMENT)), "items")
    ratios = f.ratios(usable.repartition(parts, "company_id"), p.bars(spark, sf_dir, parts)).filter("ratio_name like 'price_to_earnings%' or ratio_name like 'net_margin%'")
    eps = v.latest_eps(usable, _as_of())
    shown = ratios.select("company_id", "statement_type", "fiscal_period", "ratio_name", F.round("value", 6).alias("value"))
    none = F.lit(None).cast("string")
    return shown.unionByName(eps.select("company_id", none.alias("statement_type"), none.alias("fiscal_period"), F.lit("eps").alias("ratio_name"), F.round("eps", 6).alias("value")))


_THIN = _RATIOS.replace(_WIDE, f"""fewer AS (
  SELECT * FROM items WHERE company_id % 5 <> 0 OR statement_type = 'annual' OR account_code IN ('revenue', 'net_income')
), eps AS (SELECT {_KEYS}, value * 0.9 AS diluted FROM items WHERE account_code = 'eps_basic' AND company_id % 2 = 0
), wide AS (SELECT {_KEYS}, {_CODES.replace(" AS eps_basic", " AS eps_plain")}, coalesce(max(diluted), max(CASE WHEN account_code = 'eps_basic' THEN value END)) AS eps_basic
  FROM fewer LEFT JOIN eps USING ({_KEYS}) WHERE company_id % 5 <> 0 OR statement_type = 'annual' GROUP BY {_KEYS})""")
THIN = f"""
WITH {_THIN}
SELECT company_id, statement_type, fiscal_period, ratio_name, round(value, 6) AS value FROM ratios WHERE ratio IN ('price_to_earnings', 'net_margin')
UNION ALL SELECT company_id, NULL, NULL, 'eps', round(arg_max(eps_basic, (available_at, CAST(company_id % 2 = 0 AS INTEGER), period_end, statement_type)), 6)
FROM wide WHERE eps_basic IS NOT NULL AND available_at <= DATE '{AS_OF}' GROUP BY company_id"""


def asof_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the whole newest quarterly net margin and current ratio known on its day."""
    parts = p.parts_for(spark, sf_dir)
    bars = p.bars(spark, sf_dir, parts)
    known = f.ratios(p.items(spark, sf_dir, parts), bars).filter("statement_type = 'quarterly'")
    value = lambda name: F.max(F.when(F.col("ratio_name") == name, F.col("value"))).alias(name)
    wide = known.groupBy("company_id", "available_at").agg(value("net_margin__quarterly"), value("current_ratio__quarterly"))
    bars = bars.select("company_id", "trade_date")
    out = asof_join(bars, wide, "company_id", "trade_date", "available_at")
    return out.select("company_id", "trade_date", *(F.round(f"{c}__quarterly", 6).alias(f"fund_{c}") for c in ("net_margin", "current_ratio")))


ASOF_RATIOS = f"""
WITH {_RATIOS}, w AS (
  SELECT company_id, available_at, max(CASE WHEN ratio = 'net_margin' THEN value END) AS nm, max(CASE WHEN ratio = 'current_ratio' THEN value END) AS cr
  FROM ratios WHERE statement_type = 'quarterly' GROUP BY 1, 2)
SELECT b.company_id, b.trade_date, round(nm, 6) AS fund_net_margin, round(cr, 6) AS fund_current_ratio
FROM bars b ASOF LEFT JOIN w ON w.company_id = b.company_id AND b.trade_date >= w.available_at"""

#: CTE of the newest applicable value of each ratio, everything or as of a date.
_LATEST = """latest{name} AS (SELECT company_id, ratio, value FROM ratios WHERE is_applicable {when}
  QUALIFY row_number() OVER (PARTITION BY company_id, ratio ORDER BY available_at DESC, period_end DESC, ratio_name DESC) = 1)"""
_NOW, _THEN = _LATEST.format(name="", when=""), _LATEST.format(name="_then", when=f"AND available_at <= DATE '{AS_OF}'")


def sector_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, W31."""
    return f.sector_percentiles(_ratios(spark, sf_dir), p.companies(spark, sf_dir)).withColumn("value", F.round("value", 6))


_SECTOR_ROWS = """
WITH k AS (
  SELECT l.*, sector FROM latest l JOIN companies c USING (company_id) WHERE asset_type = 'equity' AND ratio IN ('net_margin', 'roe', 'debt_to_equity')
)
SELECT company_id, ratio || '_percentile_in_sector' AS metric_name,
       round((rank() OVER (PARTITION BY sector, ratio ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY sector, ratio, value))
         / count(*) OVER (PARTITION BY sector, ratio) * 100, 6) AS value
FROM k QUALIFY count(*) OVER (PARTITION BY sector, ratio) >= 3"""
SECTOR = f"WITH {_RATIOS}, {_NOW}, m AS ({_SECTOR_ROWS}) SELECT * FROM m"


def _valued(spark: SparkSession, sf_dir: str, companies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(valuations, ratios).  Items, bars, ratios and companies are stored once: a dozen branches read them, and the base table is
    read for them three times, not once for each branch."""
    companies = stored(p.companies(spark, sf_dir), "companies") if companies is None else companies
    parts = p.parts_for(spark, sf_dir)
    items, bars = stored(p.items(spark, sf_dir, parts), "items"), stored(p.bars(spark, sf_dir, parts).select("company_id", "trade_date", "close"), "bars")
    ratios = stored(f.ratios(items, bars, parts), "ratios")
    return v.valuations(companies, items, ratios, bars, _as_of(), ASSUMED), ratios


_STEPS = (-v.STEP, 0.0, v.STEP)
#: Column and key of each grid cell, by steps of the discount and the growth rate.
_CELLS = {
    f"grid_{i}{j}": f"discount_{ASSUMED.discount_rate + a:.4f}__growth_{ASSUMED.growth_rate + b:.4f}" for i, a in enumerate(_STEPS) for j, b in enumerate(_STEPS)
}


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine grid cells, and the methods as text."""
    weights = F.array_join(F.transform(F.array_sort(F.map_keys("methods_used")), lambda k: k), ",")
    shown = [F.round(f"fair_value_{s}", 4).alias(f"fair_value_{s}") for s in (*v.SCENARIOS, "conservative")]
    cells = [F.round(F.col("grid")[k], 4).alias(n) for n, k in _CELLS.items()]
    price = F.col("current_price").alias("current_price")
    return _valued(spark, sf_dir)[0].select("company_id", *shown, weights.alias("methods"), F.round("data_quality_score", 6).alias("data_quality_score"), price, "price_date", *cells)


def _dcf(r: float, g: float, t: float) -> str:
    flows = " + ".join(f"fcf * pow({1 + g!r}, {y}) / pow({1 + r!r}, {y})" for y in range(1, 6))
    return f"greatest(0, ({flows} + fcf * pow({1 + g!r}, 5) * {1 + t!r} / {r - t!r} / pow({1 + r!r}, 5) + cash - debt) / shares)"


def _quart(metric: str, source: str) -> str:
    return f"""CASE WHEN {metric} > 0 AND {source}_n >= 3 THEN [{metric} * {source}_q[1], {metric} * {source}_q[2], {metric} * {source}_q[3]] END"""


_R, _G, _T, _S = ASSUMED.discount_rate, ASSUMED.growth_rate, ASSUMED.terminal_rate, v.STEP
_Q = "quantile_cont(value, [0.25, 0.5, 0.75]) AS q, count(*) AS n"
_BY = ("pe", "pb", "peer_pe", "peer_pb")
_VALUED = f"""{_RATIOS}, {_THEN}
, hist AS (SELECT company_id, ratio, {_Q} FROM ratios WHERE is_applicable AND available_at <= DATE '{AS_OF}' GROUP BY 1, 2
), eq AS (SELECT * FROM companies WHERE asset_type = 'equity' AND status = 'active'
), peer AS (
  SELECT a.company_id, l.ratio, {_Q} FROM eq a JOIN eq b ON a.sector = b.sector AND a.company_id <> b.company_id
  JOIN latest_then l ON l.company_id = b.company_id AND l.value > 0 GROUP BY 1, 2
), eps AS (SELECT company_id, value AS eps FROM items WHERE account_code = 'eps_basic' AND available_at <= DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY available_at DESC, period_end DESC, statement_type DESC) = 1
), cf AS (SELECT company_id, free_cash_flow AS fcf, cash_and_equivalents AS cash, total_debt AS debt, shares_outstanding AS shares FROM wide
  WHERE statement_type = 'annual' AND available_at <= DATE '{AS_OF}' AND free_cash_flow > 0
  QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY available_at DESC, period_end DESC) = 1
), pr AS (SELECT company_id, arg_max(close, trade_date) AS current_price, max(trade_date) AS price_date FROM bars WHERE trade_date <= DATE '{AS_OF}' GROUP BY 1
), j AS (
  SELECT c.company_id, eps, bv.value AS bvps, pe.q AS pe_q, pe.n AS pe_n, pb.q AS pb_q, pb.n AS pb_n, ppe.q AS peer_pe_q, ppe.n AS peer_pe_n,
         ppb.q AS peer_pb_q, ppb.n AS peer_pb_n, fcf, cash, debt, shares, current_price, price_date
  FROM companies c LEFT JOIN eps USING (company_id) LEFT JOIN latest_then bv ON bv.company_id = c.company_id AND bv.ratio = 'book_value_per_share'
  LEFT JOIN hist pe ON pe.company_id = c.company_id AND pe.ratio = 'price_to_earnings' LEFT JOIN hist pb ON pb.company_id = c.company_id AND pb.ratio = 'price_to_book'
  LEFT JOIN peer ppe ON ppe.company_id = c.company_id AND ppe.ratio = 'price_to_earnings' LEFT JOIN peer ppb ON ppb.company_id = c.company_id AND ppb.ratio = 'price_to_book'
  LEFT JOIN cf ON cf.company_id = c.company_id LEFT JOIN pr ON pr.company_id = c.company_id
), m AS (
  SELECT *, {_quart("eps", "pe")} AS m1, {_quart("bvps", "pb")} AS m2, {_quart("eps", "peer_pe")} AS m3, {_quart("bvps", "peer_pb")} AS m4,
         CASE WHEN fcf > 0 AND shares > 0 AND cash IS NOT NULL AND debt IS NOT NULL THEN [{_dcf(_R + _S, _G - _S, _T - _S)}, {_dcf(_R, _G, _T)}, {_dcf(_R - _S, _G + _S, _T + _S)}] END AS m5,
         {", ".join(f"CASE WHEN fcf > 0 AND shares > 0 THEN {_dcf(_R + a, _G + b, _T)} END AS grid_{i}{j}" for i, a in enumerate(_STEPS) for j, b in enumerate(_STEPS))}
  FROM j
), u AS (SELECT *, list_filter([m1, m2, m3, m4, m5], lambda x: x IS NOT NULL) AS used FROM m
), valued AS (
  SELECT *, list_avg(list_transform(used, lambda x: x[1])) AS bear, list_avg(list_transform(used, lambda x: x[2])) AS base,
         list_avg(list_transform(used, lambda x: x[3])) AS bull, list_min(list_transform(used, lambda x: x[1])) AS conservative,
         (least(1, (coalesce(pe_n, 0) + coalesce(pb_n, 0)) / 16) + len(used) / 5) / 2 AS quality
  FROM u WHERE len(used) > 0
)"""
_NAMES = ", ".join(f"CASE WHEN m{i} IS NOT NULL THEN '{m}' END" for i, m in enumerate(v.METHODS, 1))
VALUATIONS = f"""
WITH {_VALUED}
SELECT company_id, round(bear, 4) AS fair_value_bear, round(base, 4) AS fair_value_base, round(bull, 4) AS fair_value_bull,
       round(conservative, 4) AS fair_value_conservative,
       array_to_string(list_sort(list_filter([{_NAMES}], lambda x: x IS NOT NULL)), ',') AS methods,
       round(quality, 6) AS data_quality_score, current_price, price_date, {", ".join(f"round({c}, 4) AS {c}" for c in _CELLS)}
FROM valued"""


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 to F22."""
    df = v.recommendations(*_valued(spark, sf_dir))
    zone = [F.round(f"entry_zone.{k}", 4).alias(f"entry_{k}") for k in ("low", "high")]
    return df.select("company_id", "label", "valuation_position", "fundamental_quality", F.round("confidence", 3).alias("confidence"), F.array_join("guardrails", ",").alias("guardrails"), *zone)


_RECOMMENDED = f"""{_VALUED}, {_NOW}
, r AS (
  SELECT valued.*, nm.value AS nm, roe.value AS roe, de.value AS de FROM valued
  LEFT JOIN latest nm ON nm.company_id = valued.company_id AND nm.ratio = 'net_margin'
  LEFT JOIN latest roe ON roe.company_id = valued.company_id AND roe.ratio = 'roe'
  LEFT JOIN latest de ON de.company_id = valued.company_id AND de.ratio = 'debt_to_equity'
), c AS (
  SELECT *, CASE WHEN current_price IS NULL OR bear IS NULL OR bull IS NULL THEN NULL WHEN current_price < bear THEN 'undervalued' WHEN current_price > bull THEN 'overvalued' ELSE 'fair' END AS vp,
         CASE WHEN nm IS NULL OR roe IS NULL THEN NULL WHEN nm <= 0 OR roe <= 0 THEN 'weak' WHEN roe >= 0.1 AND coalesce(de < 1, true) THEN 'healthy' ELSE 'mixed' END AS fq,
         (quality + ((nm IS NOT NULL)::INT + (roe IS NOT NULL)::INT + (de IS NOT NULL)::INT) / 3) / 2 AS conf
  FROM r
), recommended AS (
  SELECT *, CASE WHEN vp IS NULL OR fq IS NULL THEN 'DATA_TIDAK_MENCUKUPI' WHEN fq = 'weak' THEN 'HINDARI'
         WHEN vp = 'undervalued' THEN CASE WHEN fq = 'healthy' THEN 'LAYAK_DIBELI' ELSE 'AKUMULASI_BERTAHAP' END
         WHEN vp = 'overvalued' THEN 'TUNGGU_HARGA' ELSE 'HOLD' END AS label
  FROM c
)"""
RECOMMENDATIONS = f"""
WITH {_RECOMMENDED}
SELECT company_id, label, vp AS valuation_position, fq AS fundamental_quality, round(round_even(conf, 4), 3) AS confidence,
       array_to_string(list_filter([CASE WHEN vp IS NULL THEN 'valuation_not_computable' END, CASE WHEN fq IS NULL THEN 'fundamental_quality_not_computable' END,
         CASE WHEN de > 2 THEN 'high_leverage' END], lambda x: x IS NOT NULL), ',') AS guardrails,
       round(CASE WHEN label IN ('LAYAK_DIBELI', 'AKUMULASI_BERTAHAP', 'TUNGGU_HARGA') THEN conservative END, 4) AS entry_low,
       round(CASE WHEN label IN ('LAYAK_DIBELI', 'AKUMULASI_BERTAHAP') THEN base WHEN label = 'TUNGGU_HARGA' THEN bear END, 4) AS entry_high
FROM recommended"""


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 by confidence."""
    df = v.screener(v.recommendations(*_valued(spark, sf_dir)), p.companies(spark, sf_dir), limit=20)
    return df.select("ticker", "label", F.round("confidence", 3).alias("confidence"), "total")


SCREENER = f"""
WITH {_RECOMMENDED}
SELECT ticker, label, round(round_even(conf, 4), 3) AS confidence, (SELECT count(*) FROM recommended) AS total
FROM recommended JOIN companies USING (company_id) ORDER BY round_even(conf, 4) DESC, ticker LIMIT 20"""


def screener_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second five of one label, with how many there are."""
    df = v.screener(v.recommendations(*_valued(spark, sf_dir)), p.companies(spark, sf_dir), "HINDARI", offset=5, limit=5)
    return df.select("ticker", "label", F.round("confidence", 3).alias("confidence"), "total")


SCREENER_PAGE = f"""
WITH {_RECOMMENDED}
SELECT ticker, label, round(round_even(conf, 4), 3) AS confidence, (SELECT count(*) FROM recommended WHERE label = 'HINDARI') AS total
FROM recommended JOIN companies USING (company_id) WHERE label = 'HINDARI' ORDER BY round_even(conf, 4) DESC, ticker LIMIT 5 OFFSET 5"""


def recommendations_with_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each company's latest sentiment beside its recommendation: a flag where it is negative, and nothing else changes."""
    df = v.recommendations(*_valued(spark, sf_dir), sentiment=sentiment_by_company(spark, sf_dir))
    return df.select("company_id", "label", F.round("confidence", 3).alias("confidence"), "sentiment_label", F.array_contains("guardrails", "recent_negative_sentiment").alias("flagged"))


WITH_SENTIMENT = f"""
WITH {_RECOMMENDED}, said AS ({SENTIMENT})
SELECT company_id, label, round(round_even(conf, 4), 3) AS confidence, sentiment_label, coalesce(sentiment_label IN ('negatif', 'sangat_negatif'), false) AS flagged
FROM recommended LEFT JOIN said USING (company_id)"""


def disclosed_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks that report ratios: as a fraction or in percent they come first; others' are derived from amounts, net bad
    loans and capital included."""
    companies = p.companies(spark, sf_dir).withColumn("sector", F.when(F.col("sector") == "ASIA", "Bank")).filter("sector is not null")
    codes = {"revenue": "gross_loans", "total_debt": "non_performing_loans_gross", "current_assets": "non_performing_loans_net", "operating_income": "regulatory_capital",
             "current_liabilities": "risk_weighted_assets", "net_income": "net_interest_income", "gross_profit": "earning_assets"}
    names = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    items = p.items(spark, sf_dir).withColumn("account_code", names[F.col("account_code")]).filter("account_code is not null")
    key = F.col("company_id")
    said = {"npl_gross_ratio_reported": F.when(key % 2 == 1, (key % 7 + 1) / 100), "npl_net_ratio_reported": F.when(key % 3 == 0, (key % 5 + 1.5).cast("double")),
            "net_interest_margin_reported": F.when(key % 4 == 1, F.lit(0.05)), "capital_adequacy_ratio_reported": F.when(key % 5 == 0, F.lit(17.5))}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("account_code"), x.alias("value")) for c, x in said.items()))).alias("r")
    reported = items.filter("account_code = 'gross_loans'").select(*STATEMENT, each).select(*STATEMENT, "r.*").filter("value is not null")
    return f.disclosed_metrics(items.unionByName(reported), companies).select("company_id", "metric_name", F.round("value", 5).alias("value"), "unit")


_REPORTED = {
    "npl_gross_pct": "CASE WHEN company_id % 2 = 1 THEN (company_id % 7 + 1) / 100 * 100 WHEN revenue > 0 THEN total_debt / revenue * 100 END",
    "npl_net_pct": "CASE WHEN company_id % 3 = 0 THEN company_id % 5 + 1.5 WHEN revenue > 0 THEN current_assets / revenue * 100 END",
    "net_interest_margin_pct": "CASE WHEN company_id % 4 = 1 THEN 5.0 WHEN statement_type = 'annual' AND (gross_profit + prev) / 2 > 0 THEN net_income / ((gross_profit + prev) / 2) * 100 END",
    "capital_adequacy_ratio_pct": "CASE WHEN company_id % 5 = 0 THEN 17.5 WHEN current_liabilities > 0 THEN operating_income / current_liabilities * 100 END",
}
REPORTED = f"""
WITH {_WIDE}, cur AS (
  SELECT w.* FROM wide w JOIN companies USING (company_id) WHERE sector = 'ASIA'
  QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY available_at DESC, period_end DESC, statement_type) = 1
), n AS (
  SELECT cur.*, (SELECT arg_max(o.gross_profit, o.available_at) FROM wide o WHERE o.company_id = cur.company_id AND o.statement_type = cur.statement_type AND o.period_end < cur.period_end) AS prev FROM cur
)
SELECT company_id, metric_name, round(value, 5) AS value, 'percent' AS unit
FROM ({" UNION ALL ".join(f"SELECT company_id, '{k}' AS metric_name, CAST({e} AS DOUBLE) AS value FROM n" for k, e in _REPORTED.items())}) WHERE value IS NOT NULL"""


def disclosed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier sums as bank and mining disclosures of two regions."""
    companies = p.companies(spark, sf_dir).withColumn("sector", F.when(F.col("sector") == "ASIA", "Bank").when(F.col("sector") == "AMERICA", "Gold mining"))
    codes = {"revenue": "gross_loans", "total_debt": "non_performing_loans_gross", "total_assets": "customer_deposits", "gross_profit": "current_accounts",
             "operating_cash_flow": "savings_accounts", "net_income": "net_interest_income", "operating_income": "earning_assets",
             "cash_and_equivalents": "proven_probable_reserves", "free_cash_flow": "annual_production", "eps_basic": "stripping_ratio_reported"}
    names = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    items = p.items(spark, sf_dir).withColumn("account_code", names[F.col("account_code")]).filter("account_code is not null")
    # Every third supplier counts reserves in another unit than production, every fifth names none.
    unit = F.when(F.col("company_id") % 5 == 0, F.lit(None)).when((F.col("company_id") % 3 == 0) & (F.col("account_code") == "proven_probable_reserves"), "koz").otherwise("kt")
    units = items.filter(F.col("account_code").isin("proven_probable_reserves", "annual_production")).select(*STATEMENT, "account_code", unit.alias("unit"))
    return f.disclosed_metrics(items, companies, units).withColumn("value", F.round("value", 5))


_METRIC = {
    "npl_gross_pct": "CASE WHEN revenue > 0 THEN total_debt / revenue * 100 END",
    "net_interest_margin_pct": "CASE WHEN statement_type = 'annual' AND (operating_income + prev) / 2 > 0 THEN net_income / ((operating_income + prev) / 2) * 100 END",
    "loan_to_deposit_ratio_pct": "CASE WHEN total_assets > 0 THEN revenue / total_assets * 100 END",
    "casa_ratio_pct": "CASE WHEN total_assets > 0 THEN (gross_profit + operating_cash_flow) / total_assets * 100 END",
}
_MINED = {
    "reserve_life_years": "CASE WHEN company_id % 3 <> 0 AND company_id % 5 <> 0 AND cash_and_equivalents >= 0 AND free_cash_flow > 0 THEN cash_and_equivalents / free_cash_flow END",
    "stripping_ratio": "eps_basic",
    "proven_probable_reserves": "cash_and_equivalents",
    "annual_production": "free_cash_flow",
}
_LONG = " UNION ALL ".join(
    [f"SELECT company_id, 'bank' AS route, '{n}' AS metric_name, {e} AS value FROM n WHERE sector = 'ASIA'" for n, e in _METRIC.items()]
    + [f"SELECT company_id, 'mining', '{n}', {e} FROM n WHERE sector = 'AMERICA'" for n, e in _MINED.items()]
)
DISCLOSED = f"""
WITH {_WIDE}, cur AS (
  SELECT w.*, sector FROM wide w JOIN companies USING (company_id) WHERE sector IN ('ASIA', 'AMERICA')
  QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY available_at DESC, period_end DESC, statement_type) = 1
), n AS (
  SELECT cur.*, (SELECT arg_max(o.operating_income, o.available_at) FROM wide o WHERE o.company_id = cur.company_id AND o.statement_type = cur.statement_type AND o.period_end < cur.period_end) AS prev
  FROM cur
)
SELECT company_id, route, metric_name, round(value, 5) AS value,
       CASE WHEN route = 'bank' THEN 'percent' WHEN metric_name = 'reserve_life_years' THEN 'years' WHEN metric_name = 'stripping_ratio' THEN 'ratio'
            WHEN company_id % 5 = 0 THEN 'unit' WHEN company_id % 3 = 0 AND metric_name = 'proven_probable_reserves' THEN 'koz' ELSE 'kt' END AS unit
FROM ({_LONG}) WHERE value IS NOT NULL"""


def top_market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest active equities by shares and last known close."""
    closes = value_at(p.bars(spark, sf_dir), ["company_id"], "close", ["trade_date"], "close")
    live = p.companies(spark, sf_dir).filter("asset_type = 'equity' and status = 'active'")
    ranked = live.join(closes, "company_id").withColumn("market_cap", F.col("shares_outstanding") * F.col("close"))
    return ranked.orderBy(F.desc("market_cap"), "company_id").limit(25).select("company_id", "ticker", F.round("market_cap", 2).alias("market_cap"))


MARKET_CAP = """
SELECT company_id, ticker, round(shares_outstanding * close, 2) AS market_cap
FROM companies JOIN (SELECT company_id, arg_max(close, trade_date) AS close FROM bars GROUP BY 1) USING (company_id)
WHERE asset_type = 'equity' AND status = 'active' ORDER BY shares_outstanding * close DESC, company_id LIMIT 25"""


def provider_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of open against shipped line items in one aggregation; a side that is missing is a status, not a drop."""
    li = p.table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus").isin("F", "O"))
    side = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice") / F.col("l_quantity")))
    both = li.groupBy(F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").alias("trade_date")).agg(side("F").alias("primary_close"), side("O").alias("verification_close"))
    status, gap, percent = reconciliation("primary_close", "verification_close")
    return both.select("company_id", "trade_date", status.alias("status"), F.round(gap, 6).alias("difference"), F.round(percent, 4).alias("difference_pct"))


RECONCILIATION = """
WITH j AS (SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS trade_date, max(l_extendedprice / l_quantity) FILTER (WHERE l_linestatus = 'F') AS p,
  max(l_extendedprice / l_quantity) FILTER (WHERE l_linestatus = 'O') AS v FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1, 2)
SELECT company_id, trade_date, CASE WHEN p IS NULL OR v IS NULL THEN 'verification_unavailable' WHEN p = v THEN 'matched'
       WHEN abs(p - v) / p * 100 <= 0.5 THEN 'within_tolerance' ELSE 'mismatch' END AS status, round(abs(p - v), 6) AS difference, round(abs(p - v) / p * 100, 4) AS difference_pct
FROM j"""


def company_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest features, ratios and sector metrics, valuation and recommendation in one row for each company."""
    companies = stored(p.companies(spark, sf_dir), "companies")
    valued, ratios = _valued(spark, sf_dir, companies)
    technical = v.latest_columns(newest_features(spark, sf_dir), FEATURES, "trade_date", "technical")
    df = v.company_snapshot(companies, technical, ratios, f.sector_percentiles(ratios, companies), v.recommendations(valued, ratios))
    size = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return df.select(
        "company_id", "ticker", "sector", size("technical"), size("ratios"), size("sector_metrics"), F.col("technical")["sma_20"].alias("sma_20"), F.col("technical")["ema_12"].alias("ema_12"),
        F.round(F.col("ratios")["net_margin"], 6).alias("net_margin"), F.round(F.col("sector_metrics")["roe_percentile_in_sector"], 6).alias("roe_percentile"),
        "recommendation.label", F.round("valuation.fair_value_base", 4).alias("fair_value_base"),
    )


SNAPSHOT = f"""
WITH {_RECOMMENDED}, n AS (SELECT company_id, count(*) AS k, max(CASE WHEN ratio = 'net_margin' THEN value END) AS nm FROM latest GROUP BY 1
), tech AS (SELECT company_id, feature_name, arg_max(value, trade_date) AS value FROM ({long_rows()}) GROUP BY 1, 2
), tk AS (SELECT company_id, count(*) AS k, max(CASE WHEN feature_name = 'sma_20' THEN value END) AS sma_20, max(CASE WHEN feature_name = 'ema_12' THEN value END) AS ema_12 FROM tech GROUP BY 1
), sm AS ({_SECTOR_ROWS}), sk AS (SELECT company_id, count(*) AS k, max(CASE WHEN metric_name = 'roe_percentile_in_sector' THEN value END) AS roe FROM sm GROUP BY 1)
SELECT companies.company_id, ticker, sector, coalesce(tk.k, 0) AS n_technical, coalesce(n.k, 0) AS n_ratios, coalesce(sk.k, 0) AS n_sector_metrics, tk.sma_20, tk.ema_12,
       round(n.nm, 6) AS net_margin, round(sk.roe, 6) AS roe_percentile, label, round(base, 4) AS fair_value_base
FROM companies LEFT JOIN n USING (company_id) LEFT JOIN tk USING (company_id) LEFT JOIN sk USING (company_id) LEFT JOIN recommended USING (company_id)"""


def sector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26, A9."""
    return p.companies(spark, sf_dir).select("sector", "industry").distinct().withColumn("sector_code", sector_code("sector", "industry"))


SECTOR_CODES = """
SELECT DISTINCT sector, industry, substr(trim(regexp_replace(lower(industry), '[^a-z0-9]+', '_', 'g'), '_'), 1, 21) || '_' || substr(sha256(sector || '|' || industry), 1, 10) AS sector_code
FROM companies"""


def latest_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's last bar and how fresh it is at a moment."""
    from tidemark.functions.rules import freshness, session_open, trading_days_between

    last = latest_by(p.bars(spark, sf_dir).select("company_id", "trade_date", "close"), ["company_id"], ["trade_date"])
    moment = F.lit("2001-11-05 20:00:00").cast("timestamp_ntz")
    # The session's moments: each company's last day at an hour and minute of its own.
    at = F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("company_id") % 24).cast("int"), ((F.col("company_id") * 30) % 60).cast("int"))
    return last.select("company_id", "trade_date", "close", session_open(at).alias("session_open"), freshness("trade_date", moment).alias("freshness"), trading_days_between("trade_date", F.lit("2001-11-05").cast("date")).alias("gap"))


LATEST_BAR = """
WITH l AS (SELECT company_id, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close FROM bars GROUP BY 1),
g AS (SELECT *, CAST((SELECT count(*) FROM range(trade_date + 1, DATE '2001-11-06', INTERVAL 1 DAY) d(x) WHERE isodow(x) < 6) AS INTEGER) AS gap FROM l)
SELECT company_id, trade_date, close, isodow(trade_date) < 6 AND (company_id % 24) * 60 + company_id * 30 % 60 BETWEEN 540 AND 960 AS session_open, CASE WHEN trade_date >= DATE '2001-11-05' THEN 'fresh' WHEN gap <= 1 THEN 'awaiting_eod' WHEN gap <= 3 THEN 'provider_delayed' ELSE 'stale' END AS freshness, gap FROM g"""

QUERIES = {
    "statement_ratios": statement_ratios,
    "statement_completeness": statement_completeness,
    "thin_statements": thin_statements,
    "asof_ratios": asof_ratios,
    "sector_percentiles": sector_percentiles,
    "disclosed_metrics": disclosed_metrics,
    "valuations": valuations,
    "recommendations": recommendations,
    "screener": screener,
    "screener_page": screener_page,
    "recommendations_with_sentiment": recommendations_with_sentiment,
    "disclosed_reported": disclosed_reported,
    "company_snapshot": company_snapshot,
    "top_market_cap": top_market_cap,
    "provider_reconciliation": provider_reconciliation,
    "sector_codes": sector_codes,
    "latest_bar": latest_bar,
}
ORACLE_SQL = {
    "statement_ratios": p.oracle(STATEMENT_RATIOS, "bars", "items"),
    "statement_completeness": p.oracle(COMPLETENESS, "items"),
    "thin_statements": p.oracle(THIN, "bars", "items"),
    "asof_ratios": p.oracle(ASOF_RATIOS, "bars", "items"),
    "sector_percentiles": p.oracle(SECTOR, "bars", "items", "companies"),
    "disclosed_metrics": p.oracle(DISCLOSED, "items", "companies"),
    "valuations": p.oracle(VALUATIONS, "bars", "items", "companies"),
    "recommendations": p.oracle(RECOMMENDATIONS, "bars", "items", "companies"),
    "screener": p.oracle(SCREENER, "bars", "items", "companies"),
    "screener_page": p.oracle(SCREENER_PAGE, "bars", "items", "companies"),
    "recommendations_with_sentiment": p.oracle(WITH_SENTIMENT, "bars", "items", "companies"),
    "disclosed_reported": p.oracle(REPORTED, "items", "companies"),
    "company_snapshot": p.oracle(SNAPSHOT, "index_series", "items", "companies"),
    "top_market_cap": p.oracle(MARKET_CAP, "bars", "companies"),
    "provider_reconciliation": RECONCILIATION,
    "sector_codes": p.oracle(SECTOR_CODES, "companies"),
    "latest_bar": p.oracle(LATEST_BAR, "bars"),
}
