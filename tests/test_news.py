"""Links kept up to date, needles' bitmap, backlog in order."""

from tidemark.operators import news as n

COMPANIES = [(1, "AAA", "Alpha Beta Company"), (2, "BBB", "Gamma Delta Company"), (3, "CCC", "Epsilon Zeta Company")]
TEXTS = {1: "AAA rises", 2: "shares of gamma delta company fall", 3: "nothing here", 4: None, 5: "old epsilon works and CCC"}


def companies(spark, rows=COMPANIES):
    return spark.createDataFrame(rows, "company_id long, ticker string, company_name string")


def articles(spark, texts):
    return spark.createDataFrame(list(texts.items()), "article_id long, text string")


def plain(links):
    return sorted((r["article_id"], r["company_id"], r["match_method"]) for r in links.collect())


def fresh(spark):
    links = spark.createDataFrame([], "article_id long, company_id long, relevance_score double, match_method string, matched_text string")
    return links, spark.createDataFrame([], "article_id long, content_hash string")


def test_upkeep_links_again_what_changed_and_nothing_else(spark, monkeypatch):
    before = n.dictionary(companies(spark))
    links, seen = n.upkeep(articles(spark, TEXTS), before, *fresh(spark), before.limit(0))
    links, seen = (spark.createDataFrame(x.collect(), x.schema) for x in (links, seen))
    assert plain(links) == [(1, 1, "ticker"), (2, 2, "company_name"), (5, 3, "ticker")]
    asked = []
    whole = n.entity_links
    monkeypatch.setattr(n, "entity_links", lambda a, *x, **y: asked.append(sorted(r["article_id"] for r in a.collect())) or whole(a, *x, **y))
    # Nothing changed: nothing is linked again, and the same comes out.
    again, seen_again = n.upkeep(articles(spark, TEXTS), before, links, seen, before)
    assert asked.pop() == [] and plain(again) == plain(links) and sorted(map(tuple, seen_again.collect())) == sorted(map(tuple, seen.collect()))
    # A changed title, a company that is gone, a former name that is new, an article that is new.
    aliases = spark.createDataFrame([(3, "", "Old Epsilon Works")], "company_id long, previous_ticker string, previous_name string")
    after = n.dictionary(companies(spark, COMPANIES[1:]), aliases)
    changed = TEXTS | {2: "no name any more", 6: "BBB and old epsilon works"}
    got, _ = n.upkeep(articles(spark, changed), after, links, seen, before)
    assert asked.pop() == [1, 2, 5, 6]
    assert plain(got) == [(5, 3, "ticker"), (6, 2, "ticker"), (6, 3, "previous_name")] == plain(whole(articles(spark, changed), after))
    # An article that is not given keeps its links.
    rest, _ = n.upkeep(articles(spark, {6: changed[6]}), before, links, seen, before)
    assert plain(rest) == [*plain(links), (6, 2, "ticker")]


def test_bitmap_lets_every_needle_through(spark):
    needles = n.dictionary(companies(spark))
    given = articles(spark, TEXTS | {k: f"word{k} other{k} AAA more words {k}" for k in range(10, 60)})
    every = {tuple(r) for r in n.candidate_grams(given, needles, pruned=False).collect()}
    some = {tuple(r) for r in n.candidate_grams(given, needles).collect()}
    known = {(r["needle"], r["size"]) for r in needles.collect()}
    assert some <= every and {x for x in every if x[1:] in known} <= some and len(some) < len(every) / 3
    assert n.candidate_grams(given, needles.limit(0)).count() == 0


def test_backlog_is_scored_in_article_order(spark):
    given = articles(spark, {k: "AAA" for k in (5, 3, 9, 1)})
    pairs = spark.createDataFrame([(k, 1, "AAA") for k in (5, 3, 9, 1)], "article_id long, company_id long, matched_text string")
    done = spark.createDataFrame([(1, 1, "v1"), (3, 1, "v0")], "article_id long, company_id long, model_version string")
    got = n.score_pairs(pairs, given, companies(spark), "v1", done, limit=2).collect()
    assert sorted(r["article_id"] for r in got) == [3, 5]


def test_links_equal_their_sql_on_unusual_letters(spark, tmp_path):
    import duckdb

    from tidemark.plans import news as plans

    names = [(1, "Straße über Berge weit fort ganz"), (2, "Alpha beta gamma delta eß zeta"), (3, "Office finder works old naïve place"), (7, "Σigma kosmos vier fünf sechs sieben")]
    texts = [
        "STRASSE und STRAẞE stehen hier", "so strasse über‍ berge", "so straße über ❤️ berge weit", "Ess is no ticker, EẞS may be", "alpha‿beta gamma",
        "ALPHA BETÁ GAMMA and BETA", "oﬃce ﬁnder works", "office finder works", "naı̈ve place old", "σigma kosmos vier", "Σigma ΚΟΣΜΟΣ kosmos", "OFFICE™ finder works", "Eß eins", "", None, "alpha beta gammá",
    ]
    spark.createDataFrame(names, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, x, "en", "web", 1) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("entity_links", "news_upkeep", "company_news"):
        want = con.execute(plans.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        rows = [tuple(map(str, r)) for r in want.fetchall()]
        assert sorted(tuple(map(str, r)) for r in plans.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(rows) and rows


def test_sentiment_under_the_prior_runs_without_python(spark, capsys):
    pairs = spark.createDataFrame([(1, 1, "AAA")], "article_id long, company_id long, matched_text string")
    scored = n.score_pairs(pairs, articles(spark, TEXTS), companies(spark), "v1")
    scored.explain()
    assert "InPandas" not in capsys.readouterr().out
    own = n.score_pairs(pairs, articles(spark, TEXTS), companies(spark), "v1", scorer=lambda t: __import__("pandas").DataFrame({"positive": 0.1, "neutral": 0.8, "negative": 0.1}, index=t.index))
    assert scored.select(sorted(scored.columns)).collect() == own.select(sorted(own.columns)).collect()


def test_a_page_reads_the_texts_of_its_links_alone(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.plans import news as plans

    links = spark.createDataFrame([(c, a, 0.5) for c in (1, 2) for a in range(20) if a % c == 0], "company_id long, article_id long, relevance_score double")
    rows = [(a, "t", "u", "m", None if a in (4, 7) else f"2024-01-{a % 9 + 1:02d} 00:00:00") for a in range(20)] + [(6, "again", "u", "m", "2024-01-31 00:00:00")]
    known = spark.createDataFrame(rows, "article_id long, title string, canonical_url string, media_name string, published_at string").withColumn("published_at", F.to_timestamp("published_at"))
    scored = spark.createDataFrame([(a, f"label {k}") for a in range(20) for k in range(1 + (a % 5 == 0))], "article_id long, sentiment_label string")
    whole = n.company_news(links, known, scored, limit=5)
    some = n.first_links(links, known, 5)
    assert some.count() <= 10 < links.count() and some.columns == links.columns
    assert sorted(map(str, n.company_news(some, known, scored, limit=5).collect())) == sorted(map(str, whole.collect()))
    read, judged = [], plans._judged
    monkeypatch.setattr(plans, "_judged", lambda df: read.append(df.count()) or judged(df))
    page = plans.company_news(spark, "/root/testdata/sf0.001")
    assert read == [page.select("article_id").distinct().count()] and read[0] < 200
    # The texts are stored: in the plan no rule stands over the whole table.
    assert page._jdf.queryExecution().optimizedPlan().toString().lower().count("leftsemi") == 0
