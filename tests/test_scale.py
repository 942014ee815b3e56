"""Tasks keep their size as tables grow: where rows are dealt out, and what an aggregation holds."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest

from tidemark.operators import dataset as d
from tidemark.operators import fundamentals as f
from tidemark.operators import news as n
from tidemark.plans import catalog, fundamentals, landed, news, technical
from tidemark.plans import dataset as plans
from tidemark.sources import projections as p

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [catalog.bar_upsert, fundamentals.statement_ratios, fundamentals.asof_ratios, fundamentals.statement_completeness])
def test_partitions_grow_with_the_table(spark, monkeypatch, query):
    monkeypatch.setattr(p, "ROWS", 500)
    parts = -(-p.table(spark, SF, "lineitem").count() // 500)
    assert parts > 4
    text = plan(query(spark, SF))
    # What windows, joins and items need is dealt out once, by number; the sums of statements are shuffled before, without their items.
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", text)]
    assert dealt and set(dealt) == {parts}
    others = re.findall(r"hashpartitioning\(([^)]*), \d+\), ENSURE_REQUIREMENTS", text)
    assert all("l_suppkey" in keys for keys in others), others


def test_items_become_columns_in_one_aggregation(spark):
    day = dt.date(2000, 12, 31)
    rows = [(1, "annual", "2000FY", day, day, c, v) for c, v in (("revenue", 10.0), ("revenue", 12.0), ("net_income", None), ("other", 5.0))]
    items = spark.createDataFrame(rows, "company_id long, statement_type string, fiscal_period string, period_end date, available_at date, account_code string, value double")
    assert "pivotfirst" not in plan(f.wide_items(items)).lower()
    wide = f.wide_items(items).first()
    assert (wide.revenue, wide.net_income, wide.eps_basic) == (12.0, None, None)
    done = f.completeness(items)
    assert "count(distinct" not in plan(done).lower() and plan(done).count("HashAggregate") == 2
    assert done.first().completeness == 1 / 30  # one core code, twice; an unknown value and a foreign code count for none


@pytest.mark.parametrize("whole", [0, 40])
def test_groups_of_any_size_have_the_same_metrics(spark, monkeypatch, whole):
    r = random.Random(1)
    rows = [(g, float(r.randint(-9, 9)), r.choice([0.5, -2.0, 3.25, r.random()])) for g, n in ((1, 90), (2, 30), (None, 41), (3, 1), (4, 8)) for _ in range(n)]
    rows += [(5, float(k), 1.0) for k in range(9)] + [(6, None, 1.0)]  # a constant forecast; nothing known
    df = spark.createDataFrame(rows, "g long, y double, p double")
    read = lambda: {x["g"]: x.asDict() for x in d.regression_metrics(df, "y", "p", "g").collect()}
    small = read()
    monkeypatch.setattr(d, "WHOLE", whole)  # 0: all by slices of their values; 40: two groups only
    other = read()
    assert set(small) == set(other) == {1, 2, 3, 4, 5, None}
    for g, x in small.items():
        assert x == pytest.approx(other[g], nan_ok=True, abs=1e-12), g
    assert small[5]["spearman"] is None and small[5]["median_ae"] == 3.0


def test_labels_of_features_with_prices_need_no_join(spark):
    text = plan(plans._labelled(spark, SF))
    assert "Join" not in text and text.count("FileScan") == 1
    days = [dt.date(2024, 1, k) for k in range(1, 9)]
    bars = spark.createDataFrame([(c, day, float(k * c + k * k)) for c in (1, 2) for k, day in enumerate(days, 1)], "company_id long, trade_date date, close double")
    joined, own = (sorted(map(tuple, d.labelled(bars, b, (2, 3)).select("company_id", "trade_date", "close", "fwd_return_2d", "direction_2d", "fwd_return_3d", "direction_3d").collect())) for b in (bars, None))
    assert joined == own and len(own) == 12


def test_instance_documents_are_staged_in_few_files(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(landed, "shared_path", lambda spark, name: made.append(f"{tmp_path}/{name}-{len(made)}") or made[-1])
    landed.landed_facts(spark, SF)
    companies = p.table(spark, SF, "supplier").count()
    files = [x for x in Path(made[0]).rglob("part-*")]
    assert 0 < len(files) <= 5 < companies


def test_features_are_dealt_out_once_by_the_table(spark, monkeypatch):
    monkeypatch.setattr(p, "ROWS", 500)
    parts = -(-p.table(spark, SF, "lineitem").count() // 500)
    text = plan(technical.ewm_features(spark, SF))
    dealt = re.findall(r"hashpartitioning\(([^)]*), (\d+)\)", text)
    # The bars and the index, each by company; the index is a mean for each day.
    assert {n for k, n in dealt if "l_suppkey" in k} == {str(parts)}
    assert all("l_suppkey" in k or "trade_date" in k or "_groupingexpression" in k for k, _ in dealt), dealt


@pytest.mark.parametrize("make", [p.statements, p.items])
def test_statements_are_summed_where_their_line_items_are_dealt(spark, monkeypatch, make):
    monkeypatch.setattr(p, "ROWS", 500)
    parts = -(-p.table(spark, SF, "lineitem").count() // 500)
    text = plan(make(spark, SF))
    # No shuffle but of plain line items, by the table's size: no task sums statements of the whole table before it.
    assert set(re.findall(r"hashpartitioning\(l_suppkey#\d+L?, (\d+)\), (\w+)", text)) == {(str(parts), "REPARTITION_BY_NUM")}
    below = re.findall(r"Exchange hashpartitioning.*?FileScan", text, re.S)
    assert len(below) == text.count("hashpartitioning") and not any("Aggregate" in b for b in below)


def test_only_newest_links_are_scored(spark, monkeypatch):
    scored = []
    pairs = n.score_pairs
    monkeypatch.setattr(n, "score_pairs", lambda links, *rest: scored.append(links.count()) or pairs(links, *rest))
    df = news.sentiment_by_company(spark, SF)
    assert scored == [df.count()] and scored[0] > 5
    articles, companies = news._articles(spark, SF), news._companies(spark, SF)
    links = n.entity_links(articles.withColumn("text", articles["summary"]), n.dictionary(companies, fold=n.lowered), fold=n.lowered)
    assert links.count() > scored[0]  # a company has several
    whole = n.latest_sentiment(pairs(links, articles, companies, "rules-v1"), articles)
    read = lambda x: sorted((r.company_id, r.sentiment_label, round(r.sentiment_score, 6)) for r in x.collect())
    assert read(df) == read(whole)


def test_few_sequences_of_words_are_made(spark):
    rows = [(1, "alpha", "Alpha Bravo Charlie"), (2, "x", "Alpha Bravo Charlie Delta"), (3, "y", "Internationalised")]
    needles = n.dictionary(spark.createDataFrame(rows, "company_id long, ticker string, company_name string"), fold=n.lowered)
    assert {(r.needle, r["size"]) for r in n.heads(needles).collect()} == {("alpha", n.HEAD)}
    texts = [(1, "Of alpha, bravo; CHARLIE delta"), (2, "internationalised alpha bravo"), (3, "alpha bravo charlie"), (4, None), (5, "")]
    articles = spark.createDataFrame(texts, "article_id long, text string")
    said = n.candidate_grams(articles, needles, fold=n.lowered)
    assert re.search(r"filter\(sequence\(.*?get\(|filter\(sequence\(.*?w#\d+\[", plan(said))  # the first word is looked up by its place
    links = n.entity_links(articles, needles, fold=n.lowered).collect()
    assert sorted((r.article_id, r.company_id) for r in links) == [(1, 1), (1, 2), (2, 3), (3, 1)]
    every = n.candidate_grams(articles, needles, pruned=False, fold=n.lowered).join(needles, ["needle", "size"], "left_semi")
    assert sorted(map(tuple, said.join(needles, ["needle", "size"], "left_semi").collect())) == sorted(map(tuple, every.collect()))
