"""Committed tables: batches that die, batches that come twice, readers in between; late events under a watermark."""

import datetime as dt

import pytest

from tidemark.streaming import committed as c
from tidemark.streaming import jobs

SHAPE = "company_id long, trade_date date, close double, year int, batch long"


def bars(spark, *rows):
    return spark.createDataFrame([(k, dt.date(y, 1, 2), x, y, b) for k, y, x, b in rows], SHAPE)


def closes(table, schema):
    return sorted((r["company_id"], r["year"], r["close"]) for r in c.upserted(table, schema).collect())


def put(table, number, rows):
    return c.upsert_batch(table, number, rows, ["company_id", "trade_date"], "year", "batch")


def test_a_batch_that_dies_before_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    table = c.Committed(spark, f"{tmp_path}/t")
    one, two = bars(spark, (1, 2020, 1.0, 0), (1, 2021, 1.0, 0)), bars(spark, (1, 2021, 2.0, 1), (2, 2021, 5.0, 1))
    assert put(table, 0, one)
    with monkeypatch.context() as m:
        m.setattr(c.Committed, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            put(table, 1, two)
    assert closes(table, one.schema) == [(1, 2020, 1.0), (1, 2021, 1.0)] and table.batches() == [0]
    assert put(table, 1, two)
    want = [(1, 2020, 1.0), (1, 2021, 2.0), (2, 2021, 5.0)]
    assert closes(table, one.schema) == want
    # Tried again after its commit it changes nothing, and an older batch is not let through.
    assert not put(table, 1, bars(spark, (9, 2020, 9.0, 1))) and not put(table, 0, one)
    assert closes(table, one.schema) == want
    assert table.remove_unnamed(1) == 1  # what the dead try left; the first batch still holds 2020
    assert closes(table, one.schema) == want and table.batches() == [1]


def test_untouched_years_stay_where_they_are(spark, tmp_path):
    table = c.Committed(spark, f"{tmp_path}/t")
    put(table, 0, bars(spark, (1, 2020, 1.0, 0), (1, 2021, 1.0, 0)))
    before = table.latest()["rows"]
    put(table, 3, bars(spark, (1, 2021, 2.0, 3)))
    after = table.latest()["rows"]
    assert after["2020"] == before["2020"] and after["2021"] != before["2021"]


def test_two_parts_appear_together_or_not_at_all(spark, tmp_path):
    table = c.Committed(spark, f"{tmp_path}/t")
    rows = spark.range(3)

    class Dies:
        @property
        def write(self):
            raise OSError("killed")

    with pytest.raises(OSError, match="killed"):
        c.append_batch(table, 0, {"valid": rows, "bad": Dies()})
    assert c.appended(table, "valid", rows.schema).count() == 0
    assert c.append_batch(table, 0, {"valid": rows, "bad": rows.filter("id = 1")})
    assert not c.append_batch(table, 0, {"valid": rows, "bad": rows})
    assert c.append_batch(table, 1, {"valid": rows, "bad": rows.limit(0)})
    assert (c.appended(table, "valid", rows.schema).count(), c.appended(table, "bad", rows.schema).count()) == (6, 1)


def test_a_stream_killed_between_write_and_commit_goes_on(spark, tmp_path, monkeypatch):
    """The streaming query fails with its batch, and its successor writes the batch once."""
    shape = "company_id long, trade_date date, open double, high double, low double, close double, volume long"
    day = dt.date(2024, 1, 2)
    spark.createDataFrame([(1, day, 1.0, 2.0, 1.0, 1.5, 5), (2, day, 1.0, 0.5, 1.0, 1.5, 5)], shape).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    start = lambda: jobs.quarantine_stream(stream, f"{tmp_path}/t", f"{tmp_path}/cp")
    with monkeypatch.context() as m:
        m.setattr(c.Committed, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination()
    assert [x.count() for x in jobs.quarantined(spark, f"{tmp_path}/t", stream.schema)] == [0, 0]
    start().awaitTermination()
    start().awaitTermination()
    assert [x.count() for x in jobs.quarantined(spark, f"{tmp_path}/t", stream.schema)] == [1, 1]


def test_corrections_inside_the_delay_count_and_later_ones_are_lost(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    deliveries = [
        [(1, at(2, 9), 7, "a", 1.0, ""), (2, at(12, 9), 7, "a", 2.0, ""), (3, at(14, 12), 7, "a", 3.0, "")],
        # Watermark: the 9th, 12 o'clock.  The 9th ends after it, the 8th before.
        [(4, at(2, 10), 7, "a", 9.0, ""), (5, at(8, 10), 7, "a", 9.0, ""), (6, at(9, 10), 7, "a", 6.0, ""), (7, at(12, 10), 7, "a", 7.0, ""), (8, at(20, 9), 7, "a", 8.0, "")],
        # Now the 15th: the first delivery's days have no state any more.
        [(9, at(12, 11), 7, "a", 90.0, ""), (10, at(15, 10), 7, "a", 10.0, "")],
    ]
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, jobs.EVENTS).write.parquet(f"{tmp_path}/ev/{k}")
        bars_of = jobs.daily_bars(jobs.event_stream(spark, f"{tmp_path}/ev/*", None))
        jobs.upsert_stream(bars_of, f"{tmp_path}/bars", f"{tmp_path}/cp").awaitTermination()
    got = {r["trade_date"].day: (r["close"], r["volume"]) for r in jobs.upserted_bars(spark, f"{tmp_path}/bars", bars_of).collect()}
    assert got == {2: (1.0, 1), 9: (6.0, 1), 12: (7.0, 2), 14: (3.0, 1), 15: (10.0, 1), 20: (8.0, 1)}
