"""Streaming jobs: validate and quarantine, drop duplicates, daily bars with late corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tidemark.operators.technical import split_valid
from tidemark.streaming.committed import Committed, append_batch, appended, upsert_batch, upserted

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 8) -> DataFrame:
    """Events of a folder's files; None: all files at rest in one trigger, so that none is late for another."""
    stream = spark.readStream.schema(EVENTS)
    return (stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream).parquet(path)


def quarantine_stream(bars: DataFrame, path: str, checkpoint: str, today: Column | None = None) -> StreamingQuery:
    """Arriving bars to two tables, ``valid`` and ``bad``: the latter with every error and the raw row.

    Both parts of a batch are committed at once; a batch that is tried again replaces what its first try left, and one that
    was committed is not written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        valid, bad = split_valid(batch, F.current_date() if today is None else today)
        append_batch(Committed(batch.sparkSession, path), number, {"valid": valid, "bad": bad})

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantined(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(valid bars, bad bars as (raw_row, errors)) that ``quarantine_stream`` has committed; ``schema`` is the bars'."""
    bad = StructType().add("raw_row", schema).add("errors", ArrayType(StringType()))
    table = Committed(spark, path)
    return appended(table, "valid", schema), appended(table, "bad", bad)


def unique_stream(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "5 days") -> DataFrame:
    """The first event of each natural key; state is kept for the delay only."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_bars(events: DataFrame, time: str = "ts", delay: str = "5 days") -> DataFrame:
    """Daily bars of each key from events; windows accept corrections until the delay has passed."""
    keyed = events.withWatermark(time, delay).groupBy(F.window(time, "1 day"), F.col("user_id").alias("company_id"))
    order = F.struct(time, "event_id")
    return keyed.agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
    ).select("company_id", F.to_date("window.start").alias("trade_date"), "open", "high", "low", "close", "volume")


def upsert_stream(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed bars into a committed table kept by year, one row for each company and date: each batch merges the years it
    touches and is committed as a whole."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"year": F.year("trade_date"), "batch": F.lit(number).cast("bigint")}).persist()
        upsert_batch(Committed(batch.sparkSession, path), number, rows, ["company_id", "trade_date"], "year", "batch")
        rows.unpersist()

    return bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted_bars(spark: SparkSession, path: str, bars: DataFrame) -> DataFrame:
    """The bars that ``upsert_stream`` has committed, with the columns of ``bars``."""
    schema = StructType(list(bars.schema.fields)).add("year", IntegerType()).add("batch", LongType())
    return upserted(Committed(spark, path), schema).select(*bars.columns)
