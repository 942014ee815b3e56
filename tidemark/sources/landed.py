"""Landed provider files to tables.  Every schema is declared; bad values become null or rejects, never guesses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import available_date, fiscal_period
from tidemark.sources.stored import stored
from tidemark.sources.taxonomy import ACCOUNT_CODES, SERIES

BAR = "company_id bigint, trade_date date, open double, high double, low double, close double, adjusted_close double, volume double"
_PRICES = ("open", "high", "low", "close")


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def columnar_bars(raw: DataFrame) -> DataFrame:
    """Bars from a columnar table: NaN to null, volume to long."""
    return raw.select("company_id", "trade_date", *(_known(F.col(c)).alias(c) for c in (*_PRICES, "adjusted_close")), _known(F.col("volume")).cast("long").alias("volume"))


def json_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from {symbol, values: [{datetime, open, ...}]} with numbers as strings, "" for null."""
    value = "struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>"
    df = spark.read.schema(f"symbol string, values array<{value}>").json(path, multiLine=True).select("symbol", F.explode("values").alias("v"))
    number = lambda c, t="double": F.nullif(F.col(f"v.{c}"), F.lit("")).try_cast(t)
    return df.select("symbol", F.to_date("v.datetime").alias("trade_date"), *(number(c).alias(c) for c in _PRICES), number("volume", "bigint").alias("volume"))


def close_only_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from [{symbol, date, close, volume}]: open, high and low unknown."""
    df = spark.read.schema("symbol string, date string, close double, volume bigint").json(path, multiLine=True)
    unknown = F.lit(None).cast("double")
    return df.select("symbol", F.to_date("date").alias("trade_date"), unknown.alias("open"), unknown.alias("high"), unknown.alias("low"), "close", "volume")


def window_of(day: str, days: int = 90) -> Column:
    """The number of the request window of at most ``days`` days that a date falls in."""
    return F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / days).cast("int")


def request_windows(start: Column, end: Column, days: int = 90) -> Column:
    """Array of (since, until) that cover a span of dates in steps of at most ``days`` days, for sources that limit a request."""
    first = F.sequence(F.lit(0), F.floor(F.datediff(end, start) / days))
    return F.transform(first, lambda k: F.struct(F.date_add(start, (k * days).cast("int")).alias("since"), F.least(end, F.date_add(start, ((k + 1) * days - 1).cast("int"))).alias("until")))


def corporate_actions(dividends: DataFrame, splits: DataFrame, start: Column, end: Column) -> DataFrame:
    """Dividends (ticker, ex_date, amount) and splits (ticker, ex_date, ratio) as one table of actions."""
    down = F.col("ratio") < 1
    s = splits.select("ticker", "ex_date", F.when(down, "reverse_split").otherwise("stock_split").alias("action_type"),
                      F.when(down, F.round(1 / F.col("ratio"), 4)).otherwise(F.lit(1.0)).alias("split_from"), F.when(down, F.lit(1.0)).otherwise(F.col("ratio")).alias("split_to"))
    d = dividends.select("ticker", "ex_date", F.lit("cash_dividend").alias("action_type"), F.col("amount").alias("cash_amount"))
    return d.unionByName(s, allowMissingColumns=True).filter((F.col("ex_date") >= start) & (F.col("ex_date") <= end))


def nested_actions(spark: SparkSession, path: str, date_fields: dict[str, str]) -> DataFrame:
    """Actions from {symbol, <type>: [{<date field>, ...}]}: each type has its own date field."""
    shape = "symbol string, " + ", ".join(f"`{t}` array<map<string,string>>" for t in date_fields)
    df = spark.read.schema(shape).json(path, multiLine=True)
    out = None
    for kind, day in date_fields.items():
        part = df.select("symbol", F.lit(kind).alias("action_type"), F.explode(kind).alias("fields"))
        part = part.withColumn("ex_date", F.expr(f"try_to_date(fields['{day}'])"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def listing(raw: DataFrame) -> DataFrame:
    """Companies (symbol, name, type): suffix .JK off, rows without symbol or name left out."""
    df = raw.filter((F.trim("symbol") != "") & (F.trim("name") != ""))
    return df.select(F.regexp_replace(F.trim("symbol"), r"\.JK$", "").alias("ticker"), F.trim("name").alias("company_name"), "type")


def _observed(series: str, day: Column, value: Column, at: Column) -> list[Column]:
    return [F.lit(series).alias("series_code"), day.alias("observation_date"), value.alias("value"), at.alias("available_at")]


def dotted_observations(spark: SparkSession, path: str, series: str) -> DataFrame:
    """{observations: [{date, value}]}, "." for missing; known that day at 20:00."""
    df = spark.read.schema("observations array<struct<date:string,value:string>>").json(path, multiLine=True).select(F.explode("observations").alias("o"))
    day = F.to_date("o.date")
    return df.filter("o.value <> '.'").select(*_observed(series, day, F.col("o.value").try_cast("double"), F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(20), F.lit(0), F.lit(0))))


def annual_pair(spark: SparkSession, path: str, series: str) -> DataFrame:
    """[meta, [{date: year, value}]]: dated 31 December, known 300 days later."""
    rows = F.from_json(F.expr("cast(variant_get(parse_json(value), '$[1]') as string)"), "array<struct<date:string,value:double>>")
    df = spark.read.text(path, wholetext=True).select(F.explode(rows).alias("o")).filter("o.value is not null")
    day = F.make_date(F.col("o.date").cast("int"), F.lit(12), F.lit(31))
    return df.select(*_observed(series, day, F.col("o.value"), F.date_add(day, 300).cast("timestamp")))


def cube(spark: SparkSession, path: str, series: str, var: str) -> DataFrame:
    """{datacontent: {key: value}, tahun: [{val, label}]}: key 9999, var, 0, year (3), month; month 13 is the
    annual figure and left out; known ten days after the next month's first."""
    df = spark.read.schema("datacontent map<string,double>, tahun array<struct<val:string,label:string>>").json(path, multiLine=True)
    cells = df.select("tahun", F.explode("datacontent").alias("key", "value"))
    head = f"9999{var}0"
    rest = F.expr(f"substring(key, {len(head) + 1})")
    cells = cells.filter(F.col("key").startswith(head)).select("tahun", "value", F.substring(rest, 1, 3).alias("th"), F.expr(f"substring(key, {len(head) + 4})").cast("int").alias("month"))
    year = F.filter("tahun", lambda t: F.lpad(t["val"], 3, "0") == F.col("th"))[0]["label"].cast("int")
    day = F.last_day(F.make_date(year, F.col("month"), F.lit(1)))
    return cells.filter("month between 1 and 12").select(*_observed(series, day, F.col("value"), F.date_add(day, 11).cast("timestamp")))


#: Indonesian month names.
MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")


def indonesian_date(text: Column) -> Column:
    """'14 Agustus 2023' as a date, null if it is none."""
    parts = F.split(F.lower(F.trim(text)), r"\s+")
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)))
    month = F.try_element_at(months, F.coalesce(F.get(parts, F.lit(1)), F.lit('')))
    text = F.concat(F.get(parts, F.lit(2)), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    return F.when(F.size(parts) == 3, F.try_to_date(text, "yyyy-MM-dd"))


def local_number(text: Column) -> Column:
    """'4.25 %' or 'Rp12.480,50' as a number: a comma is the decimal mark if there is one."""
    plain = F.regexp_replace(text, r"[^0-9.,-]", "")
    return F.when(plain.contains(","), F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(plain).try_cast("double")


def html_rates(spark: SparkSession, path: str, series: str, value_column: int = 1) -> DataFrame:
    """Rows of an HTML table with a date and a rate; what cannot be read is left out; known that day at 16:00."""
    rows = F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>|&nbsp;|\s+", " ")))
    df = spark.read.text(path, wholetext=True).select(rows.alias("row")).select(cells.alias("c"))
    df = df.select(F.explode(F.filter("c", lambda x: indonesian_date(x).isNotNull())).alias("d"), "c").select(indonesian_date(F.col("d")).alias("day"), F.get("c", F.array_position("c", F.col("d")).cast("int") - 1 + value_column).alias("v"))
    at = F.make_timestamp(F.year("day"), F.month("day"), F.day("day"), F.lit(16), F.lit(0), F.lit(0))
    return df.withColumn("n", local_number(F.col("v"))).filter("n is not null").select(*_observed(series, F.col("day"), F.col("n"), at))


def sheet_series(cells: DataFrame, header_row: int, month_row: int, value_row: int) -> DataFrame:
    """(year, month, value) from landed cells (row_no, col_no, value): a block starts at each "Jan"; its year is any number
    from 1990 to 2100 in the header above the block; the last column wins for a repeated month."""
    at = lambda r, name: cells.filter(F.col("row_no") == r).select("col_no", F.col("value").alias(name))
    df = at(month_row, "m").join(at(header_row, "h"), "col_no", "left").join(at(value_row, "v"), "col_no", "left")
    short = F.lower(F.substring(F.trim("m"), 1, 3))
    months = F.create_map(*(F.lit(x) for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (m, i)))
    # One sheet row: a few hundred cells.
    df = df.withColumns({"month": F.try_element_at(months, short), "block": F.sum((short == "jan").cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("col_no"))})
    number = F.col("h").try_cast("double").try_cast("int")
    df = df.withColumn("year", F.max(F.when(number.between(1990, 2100), number)).over(Window.partitionBy("block")))
    df = df.withColumn("x", F.col("v").try_cast("double")).filter("x is not null and month is not null and year is not null")
    return df.groupBy("year", "month").agg(F.max_by("x", "col_no").alias("value"))


def close_series(bars: DataFrame, series: str) -> DataFrame:
    """A close series (trade_date, close): null closes dropped; known at the start of the next day."""
    return bars.filter("close is not null").select(*_observed(series, F.col("trade_date"), F.col("close"), F.date_add("trade_date", 1).cast("timestamp")))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items with url and title; RFC 822 dates, null where unreadable."""
    df = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return df.filter((F.trim("link") != "") & (F.trim("title") != "")).select(F.trim("link").alias("canonical_url"), F.trim("title").alias("title"), F.col("description").alias("summary"), when.alias("published_at"))


def _facts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, ord, name, context, period, text, scale, nil) of each fact of each instance document; of one that cannot be
    read, a row without a name whose text says why."""
    for part in parts:
        out = []
        for path, content in zip(part["path"], part["content"], strict=True):
            try:
                root = ElementTree.fromstring(content)
            except ElementTree.ParseError as e:
                out.append((path, 0, None, None, None, str(e), None, False))
                continue
            local = lambda tag: tag.rsplit("}", 1)[-1]
            ends = {}
            for c in root.iter():
                if local(c.tag) == "context":
                    days = [e.text for e in c.iter() if local(e.tag) in ("instant", "endDate")]
                    ends[c.get("id")] = (days[-1] or "").strip() if days else None
            for i, e in enumerate(root.iter()):
                if e.get("contextRef"):
                    nil = any(local(k) == "nil" and v == "true" for k, v in e.attrib.items())
                    out.append((path, i, e.get("name", local(e.tag)).split(":")[-1], e.get("contextRef"), ends.get(e.get("contextRef")), "".join(e.itertext()), e.get("scale"), nil))
        yield pd.DataFrame(out, columns=["path", "ord", "name", "context", "period", "text", "scale", "nil"])


def xbrl_listed(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    """Every fact of the instance documents under a path, and a row without a name for each that cannot be read: one pass over
    the files, stored, from which ``xbrl_facts`` and ``xbrl_rejects`` take theirs.

    A file is a document, or, of an archive, holds a line {path, content} for each of its documents.
    """
    files = spark.read.schema("path string, content string").json(path) if archive else spark.read.format("binaryFile").load(path).select("path", "content")
    shape = "path string, ord bigint, name string, context string, period string, text string, scale string, nil boolean"
    return stored(files.mapInPandas(_facts, shape), "facts")


def xbrl_facts(facts: DataFrame, aliases: DataFrame, period_end: str | None = None, context: str | None = None, multiplier: float = 1.0) -> DataFrame:
    """(path, account_code, value): listed facts of one context or period under standard codes; the first occurrence wins.

    Python only lists the facts of each document; names, numbers and choice are expressions.
    ``aliases`` (name, account_code) maps normalised names; unknown facts are left out.
    """
    here = (F.col("context") == context) if context else (F.to_date("period") == F.lit(period_end).cast("date"))
    text = F.regexp_replace(F.trim("text"), r"[,\s]", "")
    bare = F.regexp_replace(text, r"^\((.*)\)$", "-$1").try_cast("double")
    value = bare * F.pow(F.lit(10.0), F.coalesce(F.col("scale").try_cast("int"), F.lit(0))) * multiplier
    plain = facts.filter(here & ~F.col("nil")).select("path", "ord", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("name"), value.alias("value"))
    good = plain.filter("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return good.join(F.broadcast(aliases), "name").groupBy("path", "account_code").agg(F.min_by("value", "ord").alias("value"))


def xbrl_rejects(facts: DataFrame) -> DataFrame:
    """(path, error) of the listed documents that cannot be read."""
    return facts.filter("name is null").select("path", F.col("text").alias("error"))


def fact_aliases(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """Each standard code under its own name in words run together, and given names."""
    rows = {re.sub("[^a-z0-9]", "", c): c for c in ACCOUNT_CODES} | {re.sub("[^a-z0-9]", "", k.lower()): v for k, v in (extra or {}).items()}
    return spark.createDataFrame(list(rows.items()), "name string, account_code string")


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) filings of a manifest {filings: [...]}; the last entry of a ticker and period counts."""
    entry = "struct<ticker:string,statement_type:string,period_end:string,published_at:string,file:string>"
    df = spark.read.schema(f"filings array<{entry}>").json(path, multiLine=True).select(F.posexplode("filings").alias("pos", "e")).select("pos", "e.*")
    zone = F.col("published_at").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    errors = F.array_compact(
        F.array(
            *(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("ticker", "statement_type", "period_end", "published_at", "file")),
            F.when(~F.col("statement_type").isin("annual", "quarterly"), F.lit("statement_type is neither annual nor quarterly")),
            F.when(~zone, F.lit("published_at has no time zone")),
            F.when(F.expr("try_to_date(substring(published_at, 1, 10)) < try_to_date(period_end)"), F.lit("published before the period's end")),
            F.when(F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)"), F.lit("file lies outside the archive")),
        )
    )
    checked = df.withColumn("errors", errors)
    good = checked.filter(F.size("errors") == 0).groupBy(F.upper("ticker").alias("ticker"), F.to_date("period_end").alias("period_end"))
    rest = F.max_by(F.struct("statement_type", F.try_to_timestamp("published_at").alias("available_at"), "file"), "pos").alias("r")
    return good.agg(rest).select("ticker", "period_end", "r.*"), checked.filter(F.size("errors") > 0)


def wide_statements(wide: DataFrame, fields: DataFrame, statement_type: str) -> DataFrame:
    """Statements with a column for each period end (company_id, field, <dates>) to items; of several
    candidate fields (field, account_code, priority) the first by priority that has a value."""
    periods = [c for c in wide.columns if c not in ("company_id", "field")]
    long = wide.unpivot(["company_id", "field"], periods, "period", "value").filter("value is not null and not isnan(value)")
    items = long.join(F.broadcast(fields), "field").groupBy("company_id", F.to_date("period").alias("period_end"), "account_code").agg(F.min_by("value", "priority").alias("value"))
    kind = F.lit(statement_type)
    return items.withColumns({"statement_type": kind, "fiscal_period": fiscal_period("period_end", kind), "available_at": available_date("period_end", kind)})


def alias_rows(spark: SparkSession, path: str, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of an alias CSV."""
    shape = "ticker string, previous_ticker string, previous_name string, effective_from string, effective_to string, reason string"
    raw = spark.read.schema(shape).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", encoding="UTF-8")
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    df = raw.join(companies.select(F.col("ticker").alias("__t"), "company_id", "company_name"), F.upper(F.trim("ticker")) == F.col("__t"), "left")
    bad = {
        "unknown ticker": F.col("company_id").isNull(),
        "no previous ticker or name": F.coalesce("previous_ticker", F.lit("")).eqNullSafe("") & F.coalesce("previous_name", F.lit("")).eqNullSafe(""),
        "previous equals current": (F.upper("previous_ticker") == F.col("__t")) | (F.lower("previous_name") == F.lower("company_name")),
        "effective_from is no date": day("effective_from").isNull(),
        "effective_to is no date": F.col("effective_to").isNotNull() & day("effective_to").isNull(),
        "effective_to before effective_from": day("effective_to") < day("effective_from"),
    }
    df = df.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items()))))
    good = df.filter(F.size("errors") == 0).select("company_id", "previous_ticker", "previous_name", day("effective_from").alias("effective_from"), day("effective_to").alias("effective_to"), "reason")
    return good, df.filter(F.size("errors") > 0).select(*raw.columns, "errors")


def series_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SERIES), "series_code string, unit string, table_name string")


def routed_series(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """Points with the unit and the one table that owns their series; unknown series are left out."""
    return points.join(F.broadcast(catalog), "series_code")
