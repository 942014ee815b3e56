"""Windows over one company's bars: full-frame gates, exponential averages, ranks with ties."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of one series after which an exponential average starts a new block, so its weights stay finite.
BLOCK = 1024
#: Blocks that are carried on together.
GROUP = 256


def full(fn: Callable[[Column], Column], x: Column, n: int, by: str = "company_id", order: str = "trade_date") -> Column:
    """An aggregate over the last n rows, null unless all n values are there."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == n, fn(x).over(w))


def pieces(df: DataFrame, start: dict[str, Column], merged: Callable, levels: dict[str, int], by: str = "company_id", order: str = "trade_date") -> DataFrame:
    """``df`` with columns ``__{k}_{name}``: what the last 2 ** k rows give, k = 0 to ``levels[name]``, null unless all are known.

    A level is the one below merged with itself 2 ** k rows before: a row costs a step for each level, not one for each row of a
    frame, and nothing is subtracted, so what has left the frame leaves no trace.  All levels share one partitioning and sort.
    ``merged(rows, older, newer)`` unites two stretches; ``rows`` are the newer's and the older's.
    """
    w = Window.partitionBy(by).orderBy(order)
    df = df.withColumns({f"__0_{n}": x for n, x in start.items()})
    for k in range(max(levels.values())):
        names = [n for n in start if levels[n] > k]
        df = df.withColumns({f"__lag_{n}": F.lag(f"__{k}_{n}", 1 << k).over(w) for n in names})
        both = merged((1 << k, 1 << k), {n: F.col(f"__lag_{n}") for n in names}, {n: F.col(f"__{k}_{n}") for n in names})
        df = df.withColumns({f"__{k + 1}_{n}": x for n, x in both.items()})
    return df


def over_last(df: DataFrame, n: int, names: Iterable[str], merged: Callable, by: str = "company_id", order: str = "trade_date") -> DataFrame:
    """``df`` after ``pieces`` with columns ``__n{n}_{name}``: what the last n rows give, from one piece for each bit of n."""
    w, names = Window.partitionBy(by).orderBy(order), list(names)
    sizes = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    at = [sum(sizes[:i]) for i in range(len(sizes))]
    df = df.withColumns({f"__p{i}_{x}": F.lag(f"__{size.bit_length() - 1}_{x}", at[i]).over(w) if i else F.col(f"__{size.bit_length() - 1}_{x}") for i, size in enumerate(sizes) for x in names})
    df = df.withColumns({f"__n{n}_{x}": F.col(f"__p0_{x}") for x in names})
    for i, size in list(enumerate(sizes))[1:]:
        both = merged((at[i], size), {x: F.col(f"__p{i}_{x}") for x in names}, {x: F.col(f"__n{n}_{x}") for x in names})
        df = df.withColumns({f"__n{n}_{x}": c for x, c in both.items()})
    return df.drop(*(f"__p{i}_{x}" for i in range(len(sizes)) for x in names))


def united(rows: tuple[int, int], older: dict[str, Column], newer: dict[str, Column]) -> dict[str, Column]:
    """Two stretches as one, by kind of column: sums ``s_x``, least and greatest values ``lo_x`` and ``hi_x``, means ``m_x`` with
    sums of squares around them ``q_x``, and sums of products around the means of two series ``c_x_y``."""
    a, b = rows
    share = a * b / (a + b)
    gap = lambda x: older[f"m_{x}"] - newer[f"m_{x}"]

    def one(name: str) -> Column:
        old, new = older[name], newer[name]
        kind, *of = name.split("_")
        if kind in ("lo", "hi"):
            return F.when(old.isNotNull() & new.isNotNull(), (F.least if kind == "lo" else F.greatest)(old, new))
        if kind == "s":
            return old + new
        if kind == "m":
            return new + gap(of[0]) * (b / (a + b))
        return new + old + gap(of[0]) * gap(of[-1]) * share

    return {n: one(n) for n in newer}


def moments_of(*series: str) -> dict[str, Column]:
    """The mean and the sum of squares of single rows of each column ``__x``, and of two series the sum of products, for ``pieces``;
    unknown where the series is, and not finite where it is not."""
    value = {x: F.col(f"__{x}").cast("double") for x in series}
    out = {f"m_{x}": v for x, v in value.items()} | {f"q_{x}": v - v for x, v in value.items()}
    if len(series) == 2:
        x, y = series
        out[f"c_{x}_{y}"] = out[f"q_{x}"] + out[f"q_{y}"]
    return out


def in_rows(df: DataFrame, by: str = "company_id", order: str = "trade_date") -> DataFrame:
    """``df`` with the number of each row in its series, its block and its group, as ``ewm`` needs them."""
    w = Window.partitionBy(by).orderBy(order)
    df = df.withColumn("__row", F.row_number().over(w) - 1)
    return df.withColumns({"__block": F.floor(F.col("__row") / BLOCK), "__group": F.floor(F.col("__row") / (BLOCK * GROUP))})


def ewm(df: DataFrame, averages: dict[str, tuple[str, float, int]], by: str = "company_id", order: str = "trade_date") -> DataFrame:
    """Exponential averages: {new column: (column, alpha, least observations)}.

    y starts at the first value and follows y = (1 - a) y + a x.  A gap lets the old weight decay
    further before it meets the next value.  With a per-row coefficient this is a closed form of
    running sums, y = exp(s) * sum(a x exp(-s)) with s the running sum of log(1 - a).  The sums start anew
    every ``BLOCK`` rows, so exp(-s) stays finite on histories of any length.  What a stretch of rows does to an average is an
    affine map, y to d y + own; a row composes the maps of the blocks before it in its group of ``GROUP`` blocks, then those of
    the groups before, at most 255 and one for each 262,144 rows, not one for each block of all history.  All windows are
    partitioned by the series or finer, and name group, block and date in this order: one shuffle and one sort for all.  Rows
    numbered by ``in_rows`` before keep their numbers, so averages of averages are not sorted again.
    """
    numbered = "__row" in df.columns
    out = df if numbered else in_rows(df, by, order)
    w = Window.partitionBy(by).orderBy("__group", "__block", order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(by, "__group", "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    in_group = Window.partitionBy(by, "__group").orderBy("__block", order).rowsBetween(Window.unboundedPreceding, -1)
    names = list(averages)
    last = {n: F.last(F.when(F.col(x).isNotNull(), F.col("__row")), ignorenulls=True).over(before) for n, (x, _, _) in averages.items()}
    out = out.withColumns({f"__v_{n}": v for n, v in last.items()})
    out = out.withColumns(
        {
            f"__a_{n}": F.when(F.col(x).isNull(), F.lit(None).cast("double"))
            .when(F.col(f"__v_{n}").isNull(), F.lit(1.0))
            .otherwise(alpha / (F.pow(F.lit(1 - alpha), F.col("__row") - F.col(f"__v_{n}")) + alpha))
            for n, (x, alpha, _) in averages.items()
        }
    )
    # The first value of all has coefficient 1: nothing before it is left to decay.
    out = out.withColumns({f"__s_{n}": F.sum(F.when(F.col(f"__a_{n}") < 1, F.log(1 - F.col(f"__a_{n}"))).otherwise(0.0)).over(inside) for n in names})
    out = out.withColumns(
        {
            f"__p_{n}": F.sum(F.coalesce(F.col(f"__a_{n}") * F.col(x) * F.exp(-F.col(f"__s_{n}")), F.lit(0.0))).over(inside)
            for n, (x, _, _) in averages.items()
        }
    )
    # What the rows of the block so far do to the average that the block began with.
    out = out.withColumns({f"__d_{n}": F.exp(f"__s_{n}") for n in names}).withColumns({f"__y_{n}": F.col(f"__d_{n}") * F.col(f"__p_{n}") for n in names})
    # The same of the rows of the group so far: its blocks' maps, then the block's own.
    out = out.withColumns({f"__e_{n}": _composed(n, BLOCK, in_group) for n in names})
    out = out.withColumns({f"__y_{n}": F.col(f"__y_{n}") + F.col(f"__d_{n}") * F.col(f"__e_{n}.y") for n in names})
    out = out.withColumns({f"__d_{n}": F.col(f"__d_{n}") * F.col(f"__e_{n}.d") for n in names})
    out = out.withColumns({f"__e_{n}": _composed(n, BLOCK * GROUP, before) for n in names})
    seen = {n: F.count(x).over(w) for n, (x, _, _) in averages.items()}
    value = {n: F.col(f"__y_{n}") + F.col(f"__d_{n}") * F.col(f"__e_{n}.y") for n in names}
    out = out.withColumns({n: F.when(seen[n] >= least, value[n]) for n, (_, _, least) in averages.items()})
    return out.drop(*(() if numbered else ("__row", "__block", "__group")), *(f"__{k}_{n}" for k in "vaspdye" for n in names))


def _composed(n: str, rows: int, frame: WindowSpec) -> Column:
    """The maps at the end of each ``rows`` rows of a frame as one, which starts from nothing."""
    end = F.col("__row") % rows == rows - 1
    maps = F.collect_list(F.when(end, F.struct(F.col(f"__d_{n}").alias("d"), F.col(f"__y_{n}").alias("y")))).over(frame)
    start = F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("y"))
    return F.aggregate(maps, start, lambda m, e: F.struct((m["d"] * e["d"]).alias("d"), (m["y"] * e["d"] + e["y"]).alias("y")))


def average_rank(x: Column, *by: Column | str) -> Column:
    """Ascending rank from 1 with ties at their mean; nulls rank last."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def percent_rank_mean(x: str, *by: str) -> Column:
    """Share of the group at or below, ties at their mean (0 to 1); null stays null and counts for none."""
    known = Window.partitionBy(*by)
    return F.when(F.col(x).isNotNull(), average_rank(F.col(x), *by) / F.count(x).over(known))


def percentile_midpoint(x: str, *by: str, least: int = 3) -> Column:
    """Percent of the group below, ties half; null with fewer than ``least`` values."""
    n = F.count(x).over(Window.partitionBy(*by))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())) - 1
    return F.when(F.col(x).isNotNull() & (n >= least), (below + same * 0.5) / n * 100)
