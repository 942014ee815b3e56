"""Technical features: 36 of a company's own bars, 9 against the market index; labels ahead.

Every function takes bars (company_id, trade_date, open, high, low, close, volume ...) of all companies
and adds columns with windows over one company in date order, so Spark shuffles and sorts the bars once.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.rolling import full
from tidemark.functions.rules import bar_errors, finite, resolved_price, safe_div
from tidemark.functions.series import AT, divided, with_series

SMA = (5, 10, 20, 50, 100, 200)
MOMENTUM = (5, 20, 60, 120, 252)
BETA = (60, 252)
OUTLIER_MOVE = 0.35
YEAR = 252
LEAST_OVERLAP = 60
VERSION = "v2"

OWN = (
    *(f"sma_{n}" for n in SMA), "ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "adx_14", "rsi_14", "stoch_k_14",
    "stoch_d_3", "roc_10", "williams_r_14", *(f"momentum_{n}" for n in MOMENTUM), "bb_upper_20", "bb_middle_20", "bb_lower_20",
    "bb_bandwidth_20", "atr_14", "hist_vol_20", "hist_vol_60", "downside_vol_20", "volume_sma_20", "volume_ratio_20", "obv",
    "ad_line", "mfi_14", "adtv_20",
)
MARKET = (*(f"beta_{n}" for n in BETA), *(f"alpha_{n}" for n in BETA), *(f"relative_strength_{n}" for n in MOMENTUM))
FEATURES = OWN + MARKET
#: What features are made of.
INPUTS = ("high", "low", "close", "volume")


def W() -> WindowSpec:  # noqa: N802
    """One company in date order."""
    return Window.partitionBy("company_id").orderBy("trade_date")


def clean_prices(bars: DataFrame, policy: str = "raw") -> DataFrame:
    """One row for each bar: policy price and its source, adjustment factor, outlier flag (moves beyond
    35 % of the previous known raw close; flagged, never removed)."""
    price, source = resolved_price(policy)
    before = F.last("close", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1))
    move = F.abs(safe_div(F.col("close") - before, before))
    return bars.withColumns(
        {
            "price": price,
            "price_source": source,
            "adjustment_factor": safe_div("adjusted_close", "close"),
            "is_outlier_flagged": F.coalesce(move > OUTLIER_MOVE, F.lit(False)),
        }
    )


def split_valid(bars: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(valid bars, bars kept out as (raw_row, errors)): each bar is in one of them, whatever is null in it."""
    checked = bars.withColumn("errors", bar_errors(today, say_today=True))
    bad = checked.filter(F.size("errors") > 0).select(F.struct(*(F.col(c) for c in bars.columns)).alias("raw_row"), "errors")
    return checked.filter(F.size("errors") == 0).drop("errors"), bad


def scaled(bars: DataFrame) -> DataFrame:
    """Open, high, low and close times the adjustment factor (1 where unknown); volume as it is."""
    factor = F.coalesce("adjustment_factor", F.lit(1.0))
    return bars.withColumns({p: F.col(p) * factor for p in ("open", "high", "low", "close")})


def _rise(x: str, n: int) -> Column:
    return safe_div(x, f"__{x}_{n}") - 1


def own_features(bars: DataFrame) -> DataFrame:
    """``bars`` with the 36 features of a company's own history."""
    return _features(bars, None, OWN)


def market_features(bars: DataFrame, index: DataFrame) -> DataFrame:
    """``bars`` with the nine features against an index (trade_date, market); none for a company whose
    dates meet fewer than 60 index values.  The index is one value a day: a few thousand rows."""
    return _features(bars, index, MARKET)


def _features(bars: DataFrame, index: DataFrame | None, names: tuple[str, ...], known: str | None = None, newest: str | None = None) -> DataFrame:
    """``bars`` with the features ``names``: earlier rows' values by windows, the rest by ``with_series``."""
    own, df = index is None or known is not None or not set(names) <= set(MARKET), bars
    if own:
        df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    before = {"close": {1, 10, *MOMENTUM}} | ({"high": {1}, "low": {1}, "__tp": {1}} if own else {})
    if index is not None:
        df = df.join(F.broadcast(index.select("trade_date", "market")), "trade_date", "left")
        before["market"] = {1, *MOMENTUM}
    at = F.row_number().over(W()) - 1
    df = df.withColumns({AT: at} | {f"__{x.strip('_')}_{n}": F.lag(x, n).over(W()) for x, lags in before.items() for n in sorted(lags)})
    series: dict[str, tuple] = {}
    if own:
        df = _own_series(df)
        series |= _OWN_SERIES
    if index is not None:
        df = _market_series(df)
        series |= _MARKET_SERIES
    for name, kind, of in ((known, "known", FEATURES), (newest, "newest", names)):
        if name is not None:
            series[name] = (kind, *of)
            names = (*names, name)
    ready = [n for n in names if n not in series]
    return with_series(df, series, [*bars.columns, *ready], [n for n in names if n in series]).select(*bars.columns, *names)


def _own_series(df: DataFrame) -> DataFrame:
    """The series of a company's own bars, which sums run over, and its momentum."""
    high, low, close, volume = (F.col(c) for c in ("high", "low", "close", "volume"))
    up, down = high - F.col("__high_1"), F.col("__low_1") - low
    flow, change = F.col("__tp") * volume, F.col("__tp") - F.col("__tp_1")
    df = df.withColumns({"__delta": close - F.col("__close_1"), "__log": F.log(safe_div("close", "__close_1"))})
    known, log = F.col("__delta").isNotNull(), F.col("__log")
    return df.withColumns(
        {
            "__up": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "__down": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "__range": F.greatest(high - low, F.abs(high - F.col("__close_1")), F.abs(low - F.col("__close_1"))),
            "__gain": F.when(known, F.greatest("__delta", F.lit(0.0))),
            "__loss": F.when(known, F.greatest(-F.col("__delta"), F.lit(0.0))),
            "__flow_up": F.when(change > 0, flow).otherwise(0.0),
            "__flow_down": F.when(change < 0, flow).otherwise(0.0),
            "__obv": F.coalesce(F.signum("__delta"), F.lit(0.0)) * volume,
            "__ad": F.coalesce(safe_div((close - low) - (high - close), high - low), F.lit(0.0)) * volume,
            "__fall2": F.when(log.isNotNull(), F.pow(F.least("__log", F.lit(0.0)), F.lit(2.0))),
            "__value": close * volume,
            **{f"momentum_{n}": _rise("close", n) for n in MOMENTUM},
            "roc_10": _rise("close", 10) * 100,
        }
    )


def _directional(up: np.ndarray, down: np.ndarray, gap: np.ndarray) -> np.ndarray:
    plus, minus = divided(100 * up, gap), divided(100 * down, gap)
    return divided(100 * np.abs(plus - minus), plus + minus)


def _rising_share(rises: np.ndarray, falls: np.ndarray) -> np.ndarray:
    """An index of 0 to 100; without falls all is rises, and without either there is none."""
    return np.where(falls > 0, 100 - 100 / (1 + rises / falls), np.where(rises > 0, 100.0, np.nan))


_WILDER = 1 / 14
_OWN_SERIES = {
    "ema_12": ("ewm", "close", 2 / 13, 12),
    "ema_26": ("ewm", "close", 2 / 27, 26),
    "atr_14": ("ewm", "__range", _WILDER, 14),
    **{f"__e_{x}": ("ewm", f"__{x}", _WILDER, 14) for x in ("gain", "loss", "up", "down")},
    "rsi_14": ("choice", _rising_share, "__e_gain", "__e_loss"),
    "macd": ("formula", np.subtract, "ema_12", "ema_26"),
    "macd_signal": ("ewm", "macd", 0.2, 9),
    "macd_histogram": ("formula", np.subtract, "macd", "macd_signal"),
    "__dx": ("formula", _directional, "__e_up", "__e_down", "atr_14"),
    "adx_14": ("ewm", "__dx", _WILDER, 14),
    **{f"__close{n}": ("sum", "close", n) for n in SMA},
    **{f"sma_{n}": ("formula", lambda x, n=n: x / n, f"__close{n}") for n in SMA},
    **{f"__{x}20": ("sum", x if x == "volume" else f"__{x}", 20) for x in ("volume", "value", "fall2")},
    "volume_sma_20": ("formula", lambda x: x / 20, "__volume20"),
    "volume_ratio_20": ("formula", divided, "volume", "volume_sma_20"),
    "adtv_20": ("formula", lambda x: x / 20, "__value20"),
    "downside_vol_20": ("formula", lambda x: np.sqrt(x / 20) * math.sqrt(YEAR), "__fall220"),
    **{f"__{x}14": ("sum", f"__{x}", 14) for x in ("flow_up", "flow_down")},
    "mfi_14": ("choice", _rising_share, "__flow_up14", "__flow_down14"),
    "__low14": ("least", "low", 14),
    "__high14": ("greatest", "high", 14),
    "stoch_k_14": ("formula", lambda close, low, high: divided((close - low) * 100, high - low), "close", "__low14", "__high14"),
    "williams_r_14": ("formula", lambda close, low, high: divided((high - close) * -100, high - low), "close", "__low14", "__high14"),
    "__k3": ("sum", "stoch_k_14", 3),
    "stoch_d_3": ("formula", lambda x: x / 3, "__k3"),
    "__dev20": ("products", "close", "close", 20),
    "bb_middle_20": ("formula", lambda x: x / 20, "__close20"),
    "bb_upper_20": ("formula", lambda mean, q: mean + 2 * np.sqrt(q / 19), "bb_middle_20", "__dev20"),
    "bb_lower_20": ("formula", lambda mean, q: mean - 2 * np.sqrt(q / 19), "bb_middle_20", "__dev20"),
    "bb_bandwidth_20": ("formula", lambda mean, q: divided(4 * np.sqrt(q / 19), mean), "bb_middle_20", "__dev20"),
    **{f"__vol{n}": ("products", "__log", "__log", n) for n in (20, 60)},
    **{f"hist_vol_{n}": ("formula", lambda q, n=n: np.sqrt(q / (n - 1)) * math.sqrt(YEAR), f"__vol{n}") for n in (20, 60)},
    "obv": ("running", "__obv"),
    "ad_line": ("running", "__ad"),
}


def _if_enough(value: np.ndarray, enough: np.ndarray) -> np.ndarray:
    return np.where(enough > 0, value, np.nan)


_MARKET_SERIES = {
    **{f"__c{n}": ("products", "__x", "__y", n) for n in BETA},
    **{f"__q{n}": ("products", "__x", "__x", n) for n in BETA},
    **{f"__beta{n}": ("formula", divided, f"__c{n}", f"__q{n}") for n in BETA},
    **{f"__alpha{n}": ("formula", lambda r, beta, m: r - beta * m, "__r", f"__beta{n}", "__m") for n in BETA},
    **{f"{x}_{n}": ("choice", _if_enough, f"__{x}{n}", "__enough") for x in ("beta", "alpha") for n in BETA},
}


def _market_series(df: DataFrame) -> DataFrame:
    """Returns of bars and index where both are known, and what both gained."""
    df = df.withColumns({"__r": _rise("close", 1), "__m": _rise("market", 1)})
    both = F.col("__r").isNotNull() & F.col("__m").isNotNull()
    return df.withColumns(
        {
            "__x": F.when(both, F.col("__m")),
            "__y": F.when(both, F.col("__r")),
            "__enough": (F.count("market").over(Window.partitionBy("company_id")) >= LEAST_OVERLAP).cast("double"),
        }
    ).withColumns({f"relative_strength_{n}": F.when(F.col("__enough") > 0, _rise("close", n) - _rise("market", n)) for n in MOMENTUM})


def technical_features(bars: DataFrame, index: DataFrame, dealt: bool = False, names: tuple[str, ...] = FEATURES, known: str | None = None, newest: str | None = None) -> DataFrame:
    """All 45 features, or ``names``, as columns beside the bars; ``bars`` holds adjusted prices.  ``known`` names one more column, a long
    with a bit for each of ``FEATURES`` that is finite; ``newest`` one that is 1 in a company's last rows that know one of ``names``, else 0.

    A company's rows are dealt out by number of partitions and stay so: what is made of a row is many times its size, so partitions
    must not be united by the size of the bars.  Bars that are ``dealt`` out so by company already are not shuffled again.
    All of ``bars``' columns are carried along, so it should hold no more than is needed.
    """
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _features(bars if dealt else bars.repartition(parts, "company_id"), index, names, known, newest)


def long_features(wide: DataFrame) -> DataFrame:
    """(company_id, feature_date, feature_name, value, version): finite values only."""
    return (
        wide.unpivot(["company_id", F.col("trade_date").alias("feature_date")], list(FEATURES), "feature_name", "value")
        .filter(finite("value"))
        .withColumn("version", F.lit(VERSION))
    )


def known_bits(columns: tuple[str, ...]) -> Column:
    """A long with a bit for each column that is finite, as ``technical_features`` makes it itself."""
    return reduce(Column.bitwiseOR, (F.when(finite(c), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, c in enumerate(columns)))


def known_counts(wide: DataFrame, known: str | None = None) -> DataFrame:
    """(company_id, feature_name, version, n, first_date): what ``long_features`` holds of each company and feature, without a row for
    each value.

    Rows of a company in which the same features are known are counted first, by the bits in ``known``: a sum and a least day for
    each of 45 features at once are more code than the JVM compiles.
    """
    bits = F.col(known) if known else known_bits(FEATURES)
    counted = wide.groupBy("company_id", bits.alias("bits")).agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"))
    held = F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << j)) != 0, c) for j, c in enumerate(FEATURES))), lambda x: x.isNotNull())
    each = counted.select("company_id", F.explode(held).alias("feature_name"), "n", "first_date")
    return each.groupBy("company_id", "feature_name").agg(F.sum("n").alias("n"), F.min("first_date").alias("first_date")).select("company_id", "feature_name", F.lit(VERSION).alias("version"), "n", "first_date")


def internally_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """``bars`` with internal_close: closes before a verified split's ex date divided by its ratio, compounding.

    Splits (company_id, ex_date, split_from, split_to, is_verified) join the bars' timeline; the ratios
    of all later ex dates are a running sum of logarithms from the end.
    """
    ratio = safe_div("split_to", "split_from")
    events = splits.filter(F.col("is_verified") & (ratio > 0)).select("company_id", F.col("ex_date").alias("trade_date"), F.log(ratio).alias("__ln"))
    both = bars.withColumn("__bar", F.lit(True)).unionByName(events.withColumn("__bar", F.lit(False)), allowMissingColumns=True)
    later = Window.partitionBy("company_id").orderBy(F.desc("trade_date"), F.desc("__bar")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("internal_close", F.col("close") / F.exp(F.sum(F.coalesce("__ln", F.lit(0.0))).over(later)))
    return out.filter("__bar").select(*bars.columns, "internal_close")


def forward_labels(bars: DataFrame, horizons: tuple[int, ...] = (5, 20, 60, 120, 252), price: str = "close") -> DataFrame:
    """fwd_return_{h}d and direction_{h}d: the return h rows ahead, and whether it is positive; null at the end."""
    out = bars.withColumns({f"fwd_return_{h}d": safe_div(F.lead(price, h).over(W()), price) - 1 for h in horizons})
    return out.withColumns(
        {f"direction_{h}d": F.when(F.col(f"fwd_return_{h}d").isNotNull(), (F.col(f"fwd_return_{h}d") > 0).cast("int")) for h in horizons}
    )
