"""Scalar rules as column functions: validation, prices, percents, labels, calendar, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Bars


def bar_errors(today: Column | None = None, say_today: bool = False) -> Column:
    """Array of every error of a bar, in a fixed order; a null never fails a check.  ``say_today``: the error of a future
    date names the day it was checked on."""

    def say(*parts: str) -> Column:
        return F.concat(*(F.col(p[1:]).cast("string") if p[0] == "$" else F.lit(p) for p in parts))

    def beyond(a: str, sign: str, b: str) -> Column:
        return say(a, " (", f"${a}", f") {sign} ", b, " (", f"${b}", ")")

    checks = [(F.col(p) <= 0, say(p, " must be > 0, got ", f"${p}")) for p in PRICES]
    checks += [(F.col("high") < F.col(p), beyond("high", "<", p)) for p in ("open", "close", "low")]
    checks += [(F.col("low") > F.col(p), beyond("low", ">", p)) for p in ("open", "close")]
    checks += [(F.col("volume") < 0, say("volume must be >= 0, got ", "$volume"))]
    if today is not None:
        checks += [(F.col("trade_date") > today, F.concat(say("trade_date ", "$trade_date", " is in the future"), *([F.lit(" (today="), today.cast("string"), F.lit(")")] if say_today else [])))]
    return F.array_compact(F.array(*(F.when(bad, text) for bad, text in checks)))


POLICIES = ("raw", "provider_split_adjusted", "provider_all_adjusted", "internally_verified_adjusted")


def resolved_price(policy: str, raw: str = "close", provider: str = "adjusted_close", internal: str = "internal_close") -> tuple[Column, Column]:
    """(price, its source) under a policy; what the policy prefers falls back to raw."""
    if policy not in POLICIES:
        raise ValueError(f"unknown price policy {policy!r}; one of {POLICIES}")
    if policy == "raw":
        return F.col(raw), F.lit("raw")
    first, name = (F.col(provider), "provider") if policy.startswith("provider") else (F.col(internal), "internal")
    return F.coalesce(first, F.col(raw)), F.when(first.isNotNull(), name).otherwise("raw_fallback")


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where either is null or b is zero."""
    return F.try_divide(_c(a), _c(b))


def finite(x: Column | str) -> Column:
    return _c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf"))


def ratio_percent(num: Column | str, den: Column | str) -> Column:
    """Percent, null unless the denominator is positive."""
    return F.when(_c(den) > 0, _c(num) / _c(den) * 100)


def reported_percent(x: Column | str) -> Column:
    """A reported share (at most 1 in size) as percent, else as it is."""
    return F.when(F.abs(_c(x)) <= 1, _c(x) * 100).otherwise(_c(x))


# Companies


def asset_type(provider_type: Column | str, name: Column | str) -> Column:
    """A known provider type first, then the name's ending, then other if the provider named a type, else equity."""
    kind, name = F.lower(F.trim(F.coalesce(_c(provider_type), F.lit("")))), F.lower(F.trim(_c(name)))
    return (
        F.when(kind.isin("common stock", "equity", "stock"), "equity")
        .when(kind == "index", "index")
        .when(kind.isin("exchange traded fund", "etf"), "etf")
        .when(name.endswith(" index"), "index")
        .when(name.endswith(" etf") | name.contains("exchange traded fund"), "etf")
        .when(kind != "", "other")
        .otherwise("equity")
    )


def provider_symbol(provider: str, ticker: Column | str) -> Column:
    return F.concat(_c(ticker), F.lit(".JK")) if provider == "yahoo_finance" else _c(ticker)


def usage_restriction(provider: Column | str) -> Column:
    return F.when(_c(provider) == "yahoo_finance", "research_only").otherwise("unspecified")


def slug(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def sector_code(sector: Column | str, industry: Column | str) -> Column:
    """Slug prefix and ten hex digits of the pair's hash, 32 characters at most."""
    basis = F.concat(_c(sector), F.lit("|"), F.coalesce(_c(industry), F.lit("")))
    digest = F.substring(F.sha2(basis.cast("binary"), 256), 1, 10)
    return F.concat(F.substring(slug(F.coalesce(_c(industry), _c(sector))), 1, 21), F.lit("_"), digest)


def formula_route(sector: Column | str, subsector: Column | str) -> Column:
    """bank, mining or null, by words in "sector subsector"."""
    text = F.lower(F.concat_ws(" ", _c(sector), _c(subsector)))
    mining = text.contains("mining") | text.contains("coal") | text.contains("gold") | text.contains("oil & gas e&p")
    return F.when(text.contains("bank"), "bank").when(mining, "mining")


# Periods and calendar


def fiscal_period(period_end: Column | str, statement_type: Column | str) -> Column:
    year = F.year(_c(period_end)).cast("string")
    return F.when(_c(statement_type) == "annual", F.concat(year, F.lit("FY"))).otherwise(
        F.concat(year, F.lit("Q"), F.quarter(_c(period_end)).cast("string"))
    )


def available_date(period_end: Column | str, statement_type: Column | str) -> Column:
    """Estimated availability: 120 days after an annual period, 60 after a quarter."""
    return F.date_add(_c(period_end), F.when(_c(statement_type) == "annual", 120).otherwise(60))


def is_weekend(day: Column | str) -> Column:
    return F.weekday(_c(day)) >= 5


def previous_trading_day(day: Column | str) -> Column:
    """The last weekday before a day."""
    w = F.weekday(_c(day))
    return F.date_sub(_c(day), F.when(w == 0, 3).when(w == 6, 2).otherwise(1))


def trading_days_between(start: Column | str, end: Column | str) -> Column:
    """Weekdays after ``start`` up to and with ``end``, 0 if there are none, without a loop."""

    def through(day: Column) -> Column:
        # Weekdays from Monday 1970-01-05 up to and with the day.
        n = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))

    return F.greatest(through(_c(end)) - through(_c(start)), F.lit(0)).cast("int")


def expected_latest_day(moment: Column | str, close_hour: int = 19) -> Column:
    """The last day whose bar should exist: that day's own from the closing hour on, if it is a weekday."""
    day = F.to_date(_c(moment))
    return F.when((F.hour(_c(moment)) >= close_hour) & ~is_weekend(day), day).otherwise(previous_trading_day(day))


#: When the exchange opens and closes, Jakarta time.
SESSION = ("09:00:00", "16:00:00")


def session_open(moment: Column | str) -> Column:
    """Whether a local moment lies in a weekday's session, both ends included."""
    at = F.date_format(_c(moment), "HH:mm:ss.SSSSSS")
    return ~is_weekend(F.to_date(_c(moment))) & (at >= f"{SESSION[0]}.000000") & (at <= f"{SESSION[1]}.000000")


def freshness(latest: Column | str, moment: Column | str) -> Column:
    """fresh, awaiting_eod (one day behind), provider_delayed (up to three) or stale."""
    expected = expected_latest_day(moment)
    gap = trading_days_between(latest, expected)
    return F.when(_c(latest).isNull(), "stale").when(_c(latest) >= expected, "fresh").when(gap <= 1, "awaiting_eod").when(gap <= 3, "provider_delayed").otherwise("stale")


# Valuation and recommendation


def valuation_position(price: Column | str, bear: Column | str, bull: Column | str) -> Column:
    p, lo, hi = _c(price), _c(bear), _c(bull)
    known = p.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return F.when(known & (p < lo), "undervalued").when(known & (p > hi), "overvalued").when(known, "fair")


def fundamental_quality(net_margin: Column | str, roe: Column | str, debt_to_equity: Column | str) -> Column:
    nm, roe, de = _c(net_margin), _c(roe), _c(debt_to_equity)
    healthy = (nm > 0) & (roe >= 0.10) & (de.isNull() | (de < 1.0))
    return (
        F.when(nm.isNull() | roe.isNull(), F.lit(None).cast("string"))
        .when((nm <= 0) | (roe <= 0), "weak")
        .when(healthy, "healthy")
        .otherwise("mixed")
    )


def recommendation_label(position: Column | str, quality: Column | str) -> Column:
    p, q = _c(position), _c(quality)
    return (
        F.when(p.isNull() | q.isNull(), "DATA_TIDAK_MENCUKUPI")
        .when(q == "weak", "HINDARI")
        .when((p == "undervalued") & (q == "healthy"), "LAYAK_DIBELI")
        .when(p == "undervalued", "AKUMULASI_BERTAHAP")
        .when(p == "overvalued", "TUNGGU_HARGA")
        .otherwise("HOLD")
    )


def confidence(data_quality: Column | str, known_ratios: Column | str) -> Column:
    """Half data quality, half share of three ratios known; 0 without a valuation; half to even."""
    value = F.bround((_c(data_quality) + F.least(F.lit(1.0), _c(known_ratios) / 3)) / 2, 4)
    return F.when(_c(data_quality).isNull(), 0.0).otherwise(value)


# Reconciliation


def reconciliation(primary: Column | str, secondary: Column | str, tolerance_pct: float = 0.5) -> tuple[Column, Column, Column]:
    """(status, absolute difference, difference in percent of the primary)."""
    a, b = _c(primary), _c(secondary)
    gap = F.abs(a - b)
    percent = F.try_divide(gap, a) * 100
    status = (
        F.when(gap.isNull(), "verification_unavailable")
        .when(gap == 0, "matched")
        .when(percent <= tolerance_pct, "within_tolerance")
        .otherwise("mismatch")
    )
    return status, gap, percent
