"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds.

A window is one word of the text (runs of letters, digits and characters beyond ASCII; longer runs
in pieces of ``WINDOW`` bytes).  It is compressed with a dictionary trained on ordinary text and
with one made from toxic text; the gain is how many bytes fewer the toxic dictionary needs.  A
fixed tail that both dictionaries hold follows every window, so that frame and block costs cancel
and short windows still compress.  Equal windows have equal gains, so each task keeps a bounded
memo of gains.  A document's evidence is its largest gain and the number and share of windows
at or above the threshold gain; a logistic calibration fitted on training rows turns it into a
score.

Training uses a bounded sample of labelled rows: ``SAMPLE`` documents for each class at most, the
first by a hash of the id, of rows with crc32(id as text) mod 3 other than 1.  Near copies count
once (they share one of three smallest 5-word hashes), since a text copied many times says little
about its words.  The threshold gain and the calibration are fitted on gains under dictionaries that a row had no
part in: the rows fall into ``FOLDS`` parts by another hash, and each part is measured with dictionaries made from the
others.  Dictionaries are raw content, made from words by document counts: the toxic one
of words that at least ``LEAST_SHARE`` of toxic documents share and that are ``ODDS`` times as
likely in toxic as in ordinary documents, the ordinary one of the words that most ordinary documents
share.  Commoner words stand last, where matching is cheapest.  The counts are aggregated in
Spark; at most ``LEXICON`` and ``ORDINARY`` words reach the driver.

Defined cases: a null or empty text has no windows, hence no evidence, and gets the score of no evidence;
a null id is held out; rows without a label only get scored; without labelled toxic and ordinary rows every score is 0;
a part whose others hold one class only is measured with the dictionaries of all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, free_name, map_texts, texts_of

SAMPLE = 10_000
LEXICON = 2_000
LEAST_SHARE = 0.005
ODDS = 20.0
WINDOW = 48
ORDINARY = 40_000
DICTIONARY = 400_000
LEVEL = 3
THRESHOLD = 0.7
#: Parts of the sample, each measured with dictionaries made from the others.
FOLDS = 6
MEMO = 150_000
#: Gains from here on are alike: no window of ``WINDOW`` bytes with a tail both dictionaries hold says more.
MOST = 12
_TAIL = bytes(range(32))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows(text: str) -> list[bytes]:
    found = _WORD.findall(text.encode().translate(LOWER))
    if any(len(w) > WINDOW for w in found):
        return [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]
    return found


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


@dataclass(frozen=True)
class Model:
    """What a task needs: both dictionaries, the threshold gain and the calibration's weights."""

    ordinary: bytes
    toxic: bytes
    gain: int
    weights: tuple[float, ...]


def _length(dictionary: bytes) -> Callable[[bytes], int]:
    import zstandard as z

    data = z.ZstdCompressionDict(dictionary + _TAIL, dict_type=z.DICT_TYPE_RAWCONTENT)
    how = z.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(dictionary), format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0
    )
    data.precompute_compress(compression_params=how)
    compress = z.ZstdCompressor(dict_data=data, compression_params=how).compress
    return lambda w: len(compress(w + _TAIL))


class Gains:
    """Gain of a window, with a memo that is emptied when full."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.memo = _length(ordinary), _length(toxic), {}

    def of(self, words: Iterable[bytes]) -> list[int]:
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            g = memo.get(w)
            if g is None:
                padded = _padded(w)
                g = memo[w] = self.ordinary(padded) - self.toxic(padded)
            out.append(g)
        return out


def evidence(counts: np.ndarray, threshold: int) -> np.ndarray:
    """For rows of counts by gain: the largest gain, and the logs of the number and of the share (per
    thousand) of windows at or above the threshold, and 1."""
    most = np.where(counts > 0, np.arange(counts.shape[1]), 0).max(axis=1)
    at = counts[:, threshold:].sum(axis=1)
    share = np.log1p(1000 * at / np.maximum(1, counts.sum(axis=1)))
    return np.stack([most, np.log1p(at), share, np.ones(len(counts))], axis=1)


def by_gain(gains: list[int]) -> np.ndarray:
    """How many windows have each gain, negative gains counted as 0 and those over ``MOST`` as ``MOST``."""
    return np.bincount(np.clip(np.asarray(gains, dtype=np.int64), 0, MOST), minlength=MOST + 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; a class's rows weigh by the root of how rare it is, between
    counting rows alike and counting classes alike, since toxic rows are few and missing one is as bad as a false alarm."""
    w = np.zeros(x.shape[1])
    balance = np.sqrt(np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (balance * (y - p)) - ridge * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the training rows: ``most`` for each class at most, the first by hash.

    A document whose labels disagree teaches nothing; one whose rows hold different texts counts with the least of them."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter((crc % 3 != 1) & F.col("toxic").isin(0, 1))
    rows = marked.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [rows.filter(F.col("toxic") == y).orderBy(*order).limit(most) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = texts_of(docs, "doc_id", "text").join(chosen, "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _first_copies(rows: DataFrame) -> DataFrame:
    """The rows that come first by id under each of their three copy keys."""

    def make() -> Callable:
        import xxhash

        def keys(text: str) -> list[int]:
            words = text.encode().translate(LOWER).split()
            five = list(map(b" ".join, zip(*(words[i:] for i in range(5)), strict=False))) or [text.encode()]
            return [min(xxhash.xxh64_intdigest(w, seed) for w in five) >> 1 for seed in (1, 2, 3)]

        return lambda texts: [pa.array([keys(t) for t in texts], pa.list_(pa.int64()))]

    keyed = map_texts(rows, make, "copies array<bigint>").select("doc_id", F.posexplode("copies").alias("seed", "copy"))
    least = keyed.groupBy("seed", "copy").agg(F.min("doc_id").alias("doc_id"))
    first = least.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n = 3")
    return rows.join(first, "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """Both dictionaries and the calibration from a bounded sample of labelled rows; None without both classes."""
    sampled = sample(docs, labels, most).persist()
    rows = _first_copies(sampled).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")).persist()
    counts = _word_counts(rows).persist()
    try:
        n = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
        per_class = {y: sum(k for (c, _), k in n.items() if c == y) for y in (0, 1)}
        if not per_class[0] or not per_class[1]:
            return None
        made = [_dictionaries(counts, per_class, None)]
        for fold in range(FOLDS):
            others = {y: per_class[y] - n.get((y, fold), 0) for y in (0, 1)}
            made.append(_dictionaries(counts, others, fold) if others[0] and others[1] else made[0])
        return _calibrate(rows, made)
    finally:
        counts.unpersist()
        rows.unpersist()
        sampled.unpersist()


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, t0, c0, t1, ...): how many toxic and ordinary rows of each fold hold a word."""

    def make() -> Callable:
        return lambda texts: [pa.array([sorted(set(windows(t))) for t in texts], pa.list_(pa.binary()))]

    words = map_texts(rows, make, "words array<binary>").select("toxic", "fold", F.explode("words").alias("word"))
    each = [F.count_if((F.col("fold") == k) & (F.col("toxic") == y)).alias(f"{n}{k}") for k in range(FOLDS) for y, n in ((1, "t"), (0, "c"))]
    return words.groupBy("word").agg(F.count("*").alias("n"), *each).filter("n > 1").drop("n")


def _dictionaries(counts: DataFrame, per_class: dict[int, int], without: int | None) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from all rows, or from all but those of one fold."""
    t, c = (sum((F.col(f"{n}{k}") for k in range(FOLDS) if k != without), F.lit(0)) for n in "tc")
    known = counts.select("word", t.alias("t"), c.alias("c")).filter("t + c > 1")
    least = max(3, math.ceil(per_class[1] * LEAST_SHARE))
    odds = ((F.col("t") + 0.5) / (per_class[1] + 1)) / ((F.col("c") + 0.5) / (per_class[0] + 1))
    typical = (F.col("t") >= least) & (F.length("word") >= 3) & (odds >= ODDS)
    bad = known.filter(typical).orderBy(F.desc("t"), "word").limit(LEXICON)
    usual = known.filter(~typical & (F.col("c") > 1)).orderBy(F.desc("c"), "word").limit(ORDINARY)

    def content(best: DataFrame) -> bytes:
        return b"".join(_padded(bytes(r["word"])) for r in reversed(best.select("word").collect()))[-DICTIONARY:]

    return content(usual), content(bad)


def _padded(word: bytes) -> bytes:
    return b" " + word + b" "


def _calibrate(rows: DataFrame, made: list[tuple[bytes, bytes]]) -> Model:
    """The threshold gain and the logistic weights, from the rows' gains under dictionaries of the other folds; ``made``
    holds the dictionaries of all rows and those without each fold."""
    shared = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains: dict[int, Gains] = {}
        for batch in batches:
            found = []
            for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if fold not in gains:
                    gains[fold] = Gains(*shared.value[1 + fold])
                found.append(by_gain(gains[fold].of(windows(text or ""))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], ["toxic", "counts"])

    got = rows.select("toxic", "fold", "text").mapInArrow(run, "toxic int, counts array<bigint>").collect()
    y = np.array([r["toxic"] for r in got], dtype=float)
    counts = np.array([r["counts"] for r in got])
    most = evidence(counts, 1)[:, 0]

    def split(g: int) -> float:
        return float((most[y == 1] >= g).mean() - (most[y == 0] >= g).mean())

    gain = max(range(1, MOST + 1), key=lambda g: (split(g), g))
    return Model(*made[0], gain, tuple(_logistic(evidence(counts, gain), y).tolist()))


def scorer(model: Model | None) -> Callable[[str], float]:
    """A text's score under the model; 0 without one."""
    if model is None:
        return lambda text: 0.0
    gains = Gains(model.ordinary, model.toxic)

    def one(text: str) -> float:
        z = float(evidence(by_gain(gains.of(windows(text)))[None, :], model.gain)[0] @ model.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return one


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document, in one pass and without a shuffle."""
    df = texts_of(docs, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        one = scorer(shared.value)
        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return map_texts(df, make, "score double").select(
        "doc_id", F.coalesce(crc % 3 == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below the threshold, all columns kept."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        one = scorer(shared.value)
        return lambda texts: [pa.array([one(t) >= THRESHOLD for t in texts])]

    text, toxic = free_name(docs, "as_text"), free_name(docs, "toxic")
    df = map_texts(docs.withColumn(text, F.col("text").cast("string")), make, f"{toxic} boolean", drop=(text,), text=text)
    return df.filter(~F.col(toxic)).select(*docs.columns)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
