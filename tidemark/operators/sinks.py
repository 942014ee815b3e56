"""Write modes as DataFrame merges: what a table holds after new rows arrive.

A merge returns the whole new content of a table; ``replace_partitions`` writes it partition by
partition, so only partitions that new rows touch are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str = "retrieved_at") -> DataFrame:
    """One row for each key (nulls are equal): the newest by a time column; at equal times the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(newest).desc_nulls_last(), F.desc("__new"))
    return both.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__new")


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """New keys are added; known keys take new values of the ``updated`` columns only, first-seen values stay."""
    rest = [c for c in old.columns if c not in keys]
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    one = new.dropDuplicates(keys).withColumn("__there", F.lit(True))
    joined = old.withColumn("__there", F.lit(True)).alias("o").join(one.alias("n"), on, "full")
    pick = lambda c: F.when(F.col("n.__there") & (F.lit(c in updated) | F.col("o.__there").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(pick(c) for c in rest))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Clear and rewrite: all old rows of the keys that new rows have go, the new rows come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def replace_snapshot(old: DataFrame, new: DataFrame, day: str = "as_of_date", key: str = "company_id") -> DataFrame:
    """Replace a company's snapshot of the same day; other days stay."""
    return replace_keys(old, new, [key, day])


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key the table does not hold are added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns), allowMissingColumns=True)


def by_source_priority(rows: DataFrame, keys: list[str], preferred: Column, newest: str = "retrieved_at") -> DataFrame:
    """One row for each key: a preferred source beats any other, then the newest wins."""
    w = Window.partitionBy(*keys).orderBy(preferred.desc(), F.col(newest).desc_nulls_last())
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases keyed by company, folded previous ticker and name, and start; only end and reason update."""
    fold = {"__t": F.upper(F.coalesce("previous_ticker", F.lit(""))), "__n": F.lower(F.coalesce("previous_name", F.lit("")))}
    keys = ["company_id", "__t", "__n", "effective_from"]
    return upsert_columns(old.withColumns(fold), new.withColumns(fold), keys, ["effective_to", "reason"]).drop("__t", "__n").select(*old.columns)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df``, replacing only the partitions it has rows in."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def reconciled_status(status: Column | str, before: Column | str) -> Column:
    """A bar's quality status after a check with this result; unchecked bars keep what they had."""
    c = F.col(status) if isinstance(status, str) else status
    kept = F.col(before) if isinstance(before, str) else before
    return F.when(c.isin("matched", "within_tolerance"), "reconciled_matched").when(c == "mismatch", "reconciled_mismatch").otherwise(kept)


def reconcile_back(bars: DataFrame, checked: DataFrame) -> DataFrame:
    """Bars with the reconciliation status of their company and date as quality_status; others keep theirs."""
    marks = checked.filter("status <> 'verification_unavailable'").groupBy("company_id", "trade_date").agg(F.max("status").alias("__status"))
    df = bars.join(marks, ["company_id", "trade_date"], "left")
    return df.withColumn("quality_status", reconciled_status("__status", "quality_status")).select(*bars.columns)
