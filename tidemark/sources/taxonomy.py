"""Account codes and series names."""

from __future__ import annotations

#: Core account codes by statement section.
CORE_SECTIONS = {
    "income_statement": (
        "revenue", "cost_of_revenue", "gross_profit", "operating_income", "operating_expense", "net_interest_income",
        "interest_income", "interest_expense", "ebitda", "pretax_income", "tax_expense", "net_income", "eps_basic",
        "eps_diluted", "shares_basic", "shares_diluted",
    ),
    "balance_sheet": (
        "total_assets", "total_liabilities", "total_equity", "current_assets", "current_liabilities", "total_debt",
        "cash_and_equivalents", "shares_outstanding",
    ),
    "cash_flow": (
        "operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "free_cash_flow", "capital_expenditure",
        "dividends_paid",
    ),
}
#: Codes that only banks or miners disclose.
NOTES = (
    "gross_loans", "non_performing_loans_gross", "non_performing_loans_net", "earning_assets", "regulatory_capital",
    "risk_weighted_assets", "customer_deposits", "current_accounts", "savings_accounts", "npl_gross_ratio_reported",
    "npl_net_ratio_reported", "net_interest_margin_reported", "capital_adequacy_ratio_reported",
    "proven_probable_reserves", "annual_production", "cash_cost_per_unit_reported", "stripping_ratio_reported",
)
CORE_CODES = tuple(c for codes in CORE_SECTIONS.values() for c in codes)
ACCOUNT_CODES = CORE_CODES + NOTES
SECTIONS = {c: s for s, codes in CORE_SECTIONS.items() for c in codes} | {c: "notes" for c in NOTES}

#: Fixed values: (series code, unit, destination table).
SERIES = (
    ("usdidr_fx", "idr_per_usd", "macro"),
    ("us_10y_treasury_yield", "percent", "macro"),
    ("ihsg_composite", "index_points", "industry"),
    ("wti_crude_oil", "usd_per_barrel", "industry"),
    ("id_inflation_mom", "percent_mom", "macro"),
    ("bi_rate", "percent", "macro"),
    ("usdidr_jisdor", "idr_per_usd", "macro"),
    ("id_gdp_growth_annual", "percent_yoy", "macro"),
    ("id_unemployment_rate_annual", "percent", "macro"),
    ("us_fed_funds_rate", "percent", "macro"),
    ("us_dollar_index_broad", "index_points", "macro"),
    ("bi_lending_facility_rate", "percent", "macro"),
    ("bi_deposit_facility_rate", "percent", "macro"),
)
