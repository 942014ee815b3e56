"""Point-in-time lookups: as-of joins and latest rows, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, per_column: bool = False) -> DataFrame:
    """Each left row with the values of the last right row at or before its time (equal times match).

    Both sides share one timeline, sorted by (company, time, right side first), and the last right row is
    carried forward: one shuffle and no range join.  The whole row is carried, so a null in the newest
    row stays null; ``per_column`` carries each column's last known value instead.  Right rows that share
    a time count in the order of all their columns.
    """
    values = [c for c in right.columns if c not in (by, right_time)]
    # A left row's own columns go in a struct, so names on the two sides cannot clash.
    l = left.select(F.col(by).alias("__by"), F.col(left_time).alias("__at"), F.struct(*left.columns).alias("__left"))
    r = right.select(F.col(by).alias("__by"), F.col(right_time).alias("__at"), F.struct(*values).alias("__right"))
    both = r.withColumn("__side", F.lit(0)).unionByName(l.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("__by").orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    if per_column:
        carried = [F.last(F.col(f"__right.{v}"), ignorenulls=True).over(w).alias(v) for v in values]
    else:
        row = F.last("__right", ignorenulls=True).over(w)
        carried = [row[v].alias(v) for v in values]
    # The key is the one that rows are dealt out by, so that what follows by company needs no shuffle.
    own = [F.col("__by").alias(c) if c == by else F.col(f"__left.`{c}`") for c in left.columns]
    return both.select("__by", "__left", "__side", *carried).filter("__side = 1").select(*own, *values)


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that is greatest by ``order``: an aggregation, with partial results before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def value_at(df: DataFrame, keys: list[str], value: str, order: list[str | Column], name: str) -> DataFrame:
    """(keys, name): the last non-null value by ``order``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))
