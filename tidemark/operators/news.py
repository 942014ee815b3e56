"""News: entity links, company context, finance rules, events, sentiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.asof import latest_by

#: Legal words that a name may drop.
LEGAL = ("pt", "tbk", "persero", "perseroan", "terbatas", "limited", "indonesia")
#: How sure each way of matching is.
SCORES = {"provider_ticker": 1.0, "ticker": 0.98, "previous_ticker": 0.95, "company_name": 0.90, "previous_name": 0.85}

#: Finance phrases, best and worst, and event rules in order of precedence.
POSITIVE = (
    r"\blaba(?: bersih)?\b.{0,35}\b(?:naik|tumbuh|melonjak|meningkat)\b",
    r"\b(?:mencetak|membukukan) laba\b",
    r"\bdividen\b.{0,30}\b(?:naik|meningkat|dibagikan|bayar)\b",
    r"\b(?:upgrade|menaikkan) peringkat\b",
    r"\bpendapatan\b.{0,35}\b(?:naik|tumbuh|melonjak|meningkat)\b",
)
NEGATIVE = (
    r"\b(?:rugi bersih|membukukan rugi|gagal bayar|default|pailit|pkpu|fraud|korupsi)\b",
    r"\b(?:laba|pendapatan)\b.{0,35}\b(?:turun|merosot|anjlok|menyusut)\b",
    r"\b(?:downgrade|menurunkan) peringkat\b",
    r"\b(?:suspensi|penghentian sementara) perdagangan\b",
)
EVENTS = (
    ("default_or_insolvency", "critical", "structural", r"\b(?:gagal bayar|default|pailit|pkpu)\b"),
    ("fraud_or_corruption", "critical", "structural", r"\b(?:fraud|korupsi|penggelapan)\b"),
    ("trading_suspension", "high", "temporary", NEGATIVE[3]),
    ("earnings_decline", "medium", "temporary", NEGATIVE[1]),
    ("earnings_growth", "medium", "temporary", POSITIVE[0]),
    ("dividend", "low", "temporary", r"\bdividen\b"),
)
#: Words of which a text must hold one for a phrase to match.
OPENS = {
    POSITIVE[0]: ("laba",),
    POSITIVE[1]: ("laba",),
    POSITIVE[2]: ("dividen",),
    POSITIVE[3]: ("peringkat",),
    POSITIVE[4]: ("pendapatan",),
    NEGATIVE[0]: ("rugi", "gagal bayar", "default", "pailit", "pkpu", "fraud", "korupsi"),
    NEGATIVE[1]: ("laba", "pendapatan"),
    NEGATIVE[2]: ("peringkat",),
    NEGATIVE[3]: ("perdagangan",),
    EVENTS[0][3]: ("gagal bayar", "default", "pailit", "pkpu"),
    EVENTS[1][3]: ("fraud", "korupsi", "penggelapan"),
    EVENTS[5][3]: ("dividen",),
}
NEGATION = r"\b(?:tidak|bukan|tanpa)\s+(?:pernah\s+)?"
VERY = 0.75
#: What stands between words: marks, joiners and connectors other than _ are no part of one.
GAP = r"[^\p{L}\p{N}_]+"

Fold = Callable[[Column | str], Column]


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return text.str.normalize("NFKC").str.casefold()


def lowered(text: Column | str) -> Column:
    """Lower case letter by letter with ß as ss: a plainer folding than ``folded``, made without Python."""
    text = F.col(text) if isinstance(text, str) else text
    for a, b in (("İ", "i"), ("Σ", "σ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: Letters whose upper case is several letters, letters for private use that stand for them meanwhile, and their capital if there is one.
SPREAD = "".join(c for c in map(chr, range(0x110000)) if len(c.upper()) > 1)
_ASIDE = "".join(chr(0x10F000 + k) for k in range(len(SPREAD)))
_CAPITALS = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in SPREAD)


def raised(text: Column | str) -> Column:
    """Upper case letter by letter, so ß never meets SS nor a ligature its letters."""
    return F.translate(F.upper(F.translate(text, SPREAD, _ASIDE)), _ASIDE, _CAPITALS)


def normalized(text: Column | str, fold: Fold = folded) -> Column:
    """Folded words with single spaces between."""
    return F.trim(F.regexp_replace(fold(text), GAP, " "))


def name_variants(name: Column | str, fold: Fold = folded) -> Column:
    """The normalised name, whole and without legal words, if long enough to be evidence."""
    full = normalized(name, fold)
    bare = F.array_join(F.filter(F.split(full, " "), lambda w: ~w.isin(*LEGAL)), " ")
    fit = lambda v: (F.length(v) >= 8) & ((F.size(F.split(v, " ")) >= 2) | (F.length(v) >= 12))
    return F.filter(F.array_distinct(F.array(full, bare)), fit)


def dictionary(companies: DataFrame, aliases: DataFrame | None = None, fold: Fold = folded) -> DataFrame:
    """(company_id, kind, method, needle, size): tickers as they are, names as normalised n-grams of ``size`` words.

    Texts must be folded as their dictionary is."""
    rows = companies.select("company_id", raised("ticker").alias("ticker"), "company_name", F.lit("ticker").alias("t"), F.lit("company_name").alias("n"))
    if aliases is not None:
        rows = rows.unionByName(
            aliases.select("company_id", raised("previous_ticker").alias("ticker"), F.col("previous_name").alias("company_name"), F.lit("previous_ticker").alias("t"), F.lit("previous_name").alias("n"))
        )
    tickers = rows.filter("ticker <> ''").select("company_id", F.col("t").alias("method"), F.col("ticker").alias("needle"), F.lit(0).alias("size"))
    names = rows.filter("company_name is not null").select("company_id", F.col("n").alias("method"), F.explode(name_variants("company_name", fold)).alias("needle"))
    return tickers.unionByName(names.withColumn("size", F.size(F.split("needle", " ")))).distinct()


def _grams(words: Column, n: int, starts: Callable[[Column], Column] | None = None) -> Column:
    """The sequences of ``n`` words; with ``starts`` only those whose first word it accepts, which are the only ones joined to a text."""
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    if starts is not None:
        places = F.filter(places, lambda i: starts(F.get(words, i - 1)))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


#: Bits of the needles' bitmap for each needle, and its greatest size in words of 64 bits.
BITS, MOST_WORDS = 32, 1 << 20


#: Stands for the number of words of a needle where its first word is looked up.
HEAD = -1


def heads(needles: DataFrame) -> DataFrame:
    """(needle, size): the first words of names of several words."""
    return needles.filter("size > 1").select(F.substring_index("needle", " ", 1).alias("needle"), F.lit(HEAD).alias("size")).distinct()


def _place(needle: Column, size: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(needle, size), F.lit(64 * words))


def needle_bitmap(needles: DataFrame) -> list[int]:
    """Bits at the hashes of all needles, as 64-bit words; about one other text in ``BITS`` falls on a bit too.

    Sized by the dictionary, 8 MB at most: beyond that more other texts pass, none of the needles is missed.
    """
    n = needles.count()
    words = min(MOST_WORDS, max(1, -(-n * BITS // 64)))
    at = _place(F.col("needle"), F.col("size"), words)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    rows = needles.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = [0] * words
    for r in rows:
        out[r["word"]] = r["bits"]
    return out


def _may_be(needle: Column, size: Column, bits: Column, words: int) -> Column:
    at = _place(needle, size, words)
    word = F.get(bits, F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def candidate_grams(articles: DataFrame, needles: DataFrame, text: str = "text", pruned: bool = True, fold: Fold = folded) -> DataFrame:
    """(article_id, needle, size): an article's distinct words (size 0) and n-grams of the sizes that names have.

    ``pruned``: only those on a bit of the needles' bitmap, which is tried before a row is made of them, so what is shuffled
    are hits and few others.  Of n-grams the first word is tried before, so few are made at all.
    """
    # Distinct numbers of words in names: a handful.
    sizes = [r["size"] for r in needles.filter("size > 0").select("size").distinct().collect()]
    own = articles.select("article_id", F.split(F.col(text), GAP).alias("t"), F.split(normalized(text, fold), " ").alias("w"))
    if pruned:
        bitmap = needle_bitmap(needles.select("needle", "size").unionByName(heads(needles)))
        one = articles.sparkSession.createDataFrame([(bitmap,)], "bits array<bigint>")
        own = own.crossJoin(F.broadcast(one))  # with one row

    def sized(found: Column, n: int) -> Column:
        found = F.array_distinct(found)
        if pruned:
            found = F.filter(found, lambda x: _may_be(x, F.lit(n), F.col("bits"), len(bitmap)))
        return F.transform(found, lambda x: F.struct(x.alias("needle"), F.lit(n).alias("size")))

    def starts(word: Column) -> Column:
        return _may_be(word, F.lit(HEAD), F.col("bits"), len(bitmap))

    none = F.array().cast("array<string>")
    kinds = [sized(F.coalesce("t", none), 0), *(sized(F.when(F.size("w") >= n, _grams(F.col("w"), n, starts if pruned and n > 1 else None)).otherwise(none), n) for n in sizes)]
    return own.select("article_id", F.explode(F.concat(*kinds)).alias("g")).select("article_id", "g.needle", "g.size")


def entity_links(articles: DataFrame, needles: DataFrame, text: str = "text", mentioned: str | None = None, fold: Fold = folded) -> DataFrame:
    """(article_id, company_id, relevance_score, match_method, matched_text): the best match of each pair.

    An article's distinct words (tickers are case-sensitive) and its distinct n-grams, of the sizes that
    names have, are joined to the dictionary by equality: no text is held against every name.
    """
    found = candidate_grams(articles, needles, text, fold=fold)
    hits = found.join(needles, ["needle", "size"]).select("article_id", "company_id", "method", "needle")
    if mentioned:
        said = articles.select("article_id", F.explode(F.transform(mentioned, lambda t: raised(t))).alias("needle"))
        tickers = needles.filter("size = 0").select("needle", "company_id", F.when(F.col("method") == "ticker", "provider_ticker").otherwise(F.col("method")).alias("method"))
        hits = hits.unionByName(said.join(tickers, "needle").select("article_id", "company_id", "method", "needle"))
    score = F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv))[F.col("method")]
    best = hits.withColumn("score", score).groupBy("article_id", "company_id").agg(F.max_by(F.struct("score", "method", "needle"), F.struct("score", "needle")).alias("m"))
    return best.select("article_id", "company_id", F.col("m.score").alias("relevance_score"), F.col("m.method").alias("match_method"), F.substring("m.needle", 1, 256).alias("matched_text"))


def active_equities(companies: DataFrame) -> DataFrame:
    """The companies that articles may be linked to."""
    return companies.filter("asset_type = 'equity' and status = 'active'")


def upkeep(articles: DataFrame, needles: DataFrame, links: DataFrame, seen: DataFrame, known: DataFrame, text: str = "text", fold: Fold = folded) -> tuple[DataFrame, DataFrame]:
    """(links, seen) after new and changed articles or a changed dictionary.

    ``links`` are those so far, ``seen`` (article_id, content_hash) the articles they come from, ``known`` the needles they were
    made with.  Linked again are only: articles that are new or whose text has another hash, articles linked to a company
    that lost a needle, and articles that hold a needle which is new.  Their old links go, whether or not new ones come.
    ``articles`` holds one row for each article that is to be linked; others keep what they have.  Nothing changed: the same
    links again.
    """
    hashed = articles.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    changed = hashed.join(seen, ["article_id", "content_hash"], "left_anti").select("article_id")
    lost = known.exceptAll(needles).select("company_id").distinct()
    touched = links.join(lost, "company_id", "left_semi").select("article_id").distinct()
    fresh = needles.exceptAll(known)
    still = articles.join(changed, "article_id", "left_anti")
    said = candidate_grams(still, fresh, text, fold=fold).join(fresh, ["needle", "size"], "left_semi").select("article_id")
    todo = changed.unionByName(touched).unionByName(said).distinct()
    new = entity_links(articles.join(todo, "article_id", "left_semi"), needles, text, fold=fold)
    # An article that is no longer given keeps its links: there is nothing to link it by.
    cleared = todo.join(articles.select("article_id"), "article_id", "left_semi")
    kept = links.join(cleared, "article_id", "left_anti").unionByName(new.select(*links.columns))
    rest = seen.join(hashed.select("article_id"), "article_id", "left_anti")
    return kept, rest.unionByName(hashed.select("article_id", "content_hash"))


def company_context(text: Column, *needles: Column) -> Column:
    """The sentences that name the company, joined; the whole text if none does."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
    said = F.filter(sentences, lambda s: F.exists(F.array(*(F.lower(n) for n in needles)), lambda n: F.contains(F.lower(s), n)))
    return F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise(text)


def _unnegated(text: Column, pattern: str) -> Column:
    """Whether a phrase stands somewhere without a negation right before it.

    The costly pattern runs only on texts that hold one of its opening words.
    """
    found = F.regexp_extract_all(text, F.lit(f"(?iU)((?:{NEGATION})?)(?:{pattern})"), F.lit(1))
    lowered = F.lower(text)
    some = lowered.contains("\u017f")  # the one letter beyond ASCII that ignoring case equates with one of the opening words'
    for word in OPENS[pattern]:
        some = some | lowered.contains(word)
    return F.when(some, F.array_contains(found, "")).otherwise(F.when(text.isNotNull(), False))


def finance_signal(text: Column) -> Column:
    """Positive less negative phrases, from -2 to 2."""
    count = lambda patterns: sum((_unnegated(text, p).cast("int") for p in patterns), F.lit(0))
    return F.greatest(F.lit(-2), F.least(F.lit(2), count(POSITIVE) - count(NEGATIVE)))


def calibrated(signal: Column, positive: Column, neutral: Column, negative: Column) -> dict[str, Column]:
    """Class probabilities moved by the signal, at 0 at least, and brought back to a sum of 1."""
    by = F.least(F.lit(0.70), 0.55 * F.abs(signal))
    up, down = signal > 0, signal < 0
    floor = lambda c: F.greatest(F.lit(0.0), c)
    p = F.when(up, positive + by).when(down, floor(positive - 0.3 * by)).otherwise(positive)
    n = F.when(down, negative + by).when(up, floor(negative - 0.3 * by)).otherwise(negative)
    z = F.when(up | down, floor(neutral - 0.7 * by)).otherwise(neutral)
    total = F.when(up | down, p + z + n).otherwise(F.lit(1.0))
    return {"positive": p / total, "neutral": z / total, "negative": n / total}


def sentiment_label(positive: Column, neutral: Column, negative: Column) -> Column:
    """Five labels from the likeliest class; the outer ones from 0.75 on."""
    top = F.greatest(positive, neutral, negative)
    return (
        F.when(positive == top, F.when(positive >= VERY, "sangat_positif").otherwise("positif"))
        .when(neutral == top, "netral")
        .otherwise(F.when(negative >= VERY, "sangat_negatif").otherwise("negatif"))
    )


def financial_event(text: Column) -> Column:
    """struct(category, severity, impact_horizon) of the first rule with a match that is not negated; null if none."""
    out = None
    for category, severity, horizon, pattern in EVENTS:
        value = F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(horizon).alias("impact_horizon"))
        hit = _unnegated(text, pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


#: The default base classifier: the same class probabilities for every text.
PRIOR = {"positive": 0.1, "neutral": 0.8, "negative": 0.1}


def base_probabilities(df: DataFrame, text: str, scorer: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """``df`` with probabilities of three classes from a user's scorer, called on batches of texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.concat([part, scorer(part[text].fillna("")).astype("float64")], axis=1)

    shape = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{shape}, positive double, neutral double, negative double")


def score_pairs(pairs: DataFrame, articles: DataFrame, companies: DataFrame, version: str, done: DataFrame | None = None, scorer: Callable | None = None, limit: int | None = None) -> DataFrame:
    """Sentiment and event of each linked pair (article_id, company_id, matched_text) that ``done`` does not hold under this
    version; with a limit, of the first pairs by article and company."""
    if done is not None:
        pairs = pairs.join(done.filter(F.col("model_version") == version).select("article_id", "company_id"), ["article_id", "company_id"], "left_anti")
    if limit is not None:
        pairs = pairs.orderBy("article_id", "company_id").limit(limit)
    df = pairs.join(articles.select("article_id", "text"), "article_id").join(companies.select("company_id", "ticker", "company_name"), "company_id")
    df = df.select("article_id", "company_id", company_context(F.col("text"), F.col("ticker"), F.col("company_name"), F.coalesce("matched_text", "ticker")).alias("context"))
    # The prior needs no text, so no context goes through Python for it.
    df = df.withColumns({c: F.lit(x) for c, x in PRIOR.items()}) if scorer is None else base_probabilities(df, "context", scorer)
    signal = finance_signal(F.col("context"))
    out = calibrated(signal, F.col("positive"), F.col("neutral"), F.col("negative"))
    df = df.withColumns({"signal": signal, "event": financial_event(F.col("context")), **out})
    return df.withColumns(
        {
            "sentiment_score": F.col("positive") - F.col("negative"),
            "sentiment_label": sentiment_label(F.col("positive"), F.col("neutral"), F.col("negative")),
            "model_version": F.lit(version),
        }
    )


def newest_links(links: DataFrame, articles: DataFrame) -> DataFrame:
    """The link of each company to its last published article: the only one whose score ``latest_sentiment`` keeps."""
    dated = links.join(articles.select("article_id", "published_at"), "article_id")
    return latest_by(dated, ["company_id"], ["published_at", "article_id"]).select(*links.columns)


def latest_sentiment(scored: DataFrame, articles: DataFrame) -> DataFrame:
    """(company_id, sentiment_label, sentiment_score) of each company's last published article."""
    df = scored.join(articles.select("article_id", "published_at"), "article_id").select("company_id", "published_at", "article_id", "sentiment_label", "sentiment_score")
    return latest_by(df, ["company_id"], ["published_at", "article_id"]).select("company_id", "sentiment_label", "sentiment_score")


def _newest() -> list[Column]:
    """A company's news in order: undated ones, then the newest."""
    return [F.col("published_at").desc_nulls_first(), F.desc("article_id")]


def first_links(links: DataFrame, articles: DataFrame, most: int) -> DataFrame:
    """The links of each company's first ``most`` articles, in the order of ``company_news``: all that its pages up to there can show."""
    df = links.join(articles.select("article_id", "published_at"), "article_id")
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(*_newest()))
    return df.withColumn("place", place).filter(F.col("place") <= most).select(links.columns).distinct()


def company_news(links: DataFrame, articles: DataFrame, scored: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of each company's linked articles, newest first and undated ones before, with their sentiment where ``scored``
    (article_id, ..., or with company_id) has one; place counts from 1.

    The window's partial limit keeps ``offset + limit`` rows of a company in each task before the shuffle.
    """
    by = ["article_id", *(["company_id"] if "company_id" in scored.columns else [])]
    df = links.join(articles.select("article_id", "title", "canonical_url", "media_name", "published_at"), "article_id").join(scored, by, "left")
    w = Window.partitionBy("company_id").orderBy(*_newest())
    return df.withColumn("place", F.row_number().over(w)).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def feed_window(items: DataFrame, since: Column, until: Column) -> DataFrame:
    """Feed items with url, title and a date inside the window."""
    return items.filter(F.col("canonical_url").isNotNull() & (F.col("title") != "") & (F.col("published_at") >= since) & (F.col("published_at") <= until))


def mentions(text: Column, ticker: str) -> Column:
    """Whole-word, case-sensitive: tickers such as EMAS are ordinary words in lower case."""
    return text.rlike(rf"(?U)\b{ticker}\b")
