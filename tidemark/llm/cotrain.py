"""Quality classification by co-training of two views.

The content view sees a document's text: shares of character classes, repetition of words and
lines, and hashed pairs of adjacent bytes' classes and words.  The metadata view sees what describes
the document: hashed source, language and their pair, and its size in characters and lines.  Each view
is a ridge logistic regression.  In every round each view labels the unlabelled documents that it
is surest of, and those labels train the other view.  Afterwards each view is calibrated on labelled
rows set aside, the calibrated views are combined by a logistic regression on the same rows, and all
documents are scored in one pass.

The labelled rows are a bounded sample, the first ``LABELLED`` by a hash of the id.  The unlabelled ones are all there are:
their features are stored once, thresholds of sureness are quantiles over all of them, and each of Newton's steps adds
up gradients and second derivatives where the features lie, so that only sums reach the driver.  A row's pseudo-label is
found anew from the rounds' weights and thresholds, of which there are a handful.  Rows with crc32(id as text) mod 3
equal to 1 are never fitted on.

Defined cases: null or empty texts and null metadata have features of their own (all shares 0, the
empty name); a null id is held out; repeated rows give repeated rows; without labelled rows of both
classes every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, remove, shared_dir

LABELLED = 6_000
ROUNDS = 5
#: Pseudo-labels a view adds in a round, as a share of the unlabelled rows left to it, for each class in proportion, and their weight.
ADDED = 0.05
PSEUDO = 0.3
#: Newton's steps of a round, from the weights of the round before; of the first round, which has labelled rows alone.
STEPS, FIRST_STEPS = 4, 15
BUCKETS = 64
META = 64
THRESHOLD = 0.5

#: Classes of bytes: other, space, line end, lower, upper, digit, sentence mark, symbol, beyond ASCII.
_CLASS = np.array(
    [
        2 if c == 10 else 1 if c in (9, 13, 32) else 3 if 97 <= c <= 122 else 4 if 65 <= c <= 90 else 5 if 48 <= c <= 57
        else 6 if chr(c) in ".,;:'\"-()" else 8 if c >= 128 else 7 if 33 <= c <= 126 else 0
        for c in range(256)
    ],
    dtype=np.int64,
)
CONTENT = 9 + 81 + 8 + BUCKETS


def content(text: str) -> np.ndarray:
    """Features of the text view, all between 0 and about 1."""
    out = np.zeros(CONTENT, dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return out
    kind = _CLASS[raw]
    out[:9] = np.bincount(kind, minlength=9) / len(raw)
    if len(raw) > 1:
        out[9:90] = np.bincount(kind[:-1] * 9 + kind[1:], minlength=81) / (len(raw) - 1)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    seen, rows = Counter(words), Counter(lines)
    out[90:98] = (
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(c for c in rows.values() if c > 1) / len(lines),
        len(rows) / len(lines),
        min(1.0, len(text) / n / 20),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(w.isupper() for w in seen) / max(1, len(seen)),
        min(1.0, np.log1p(n) / 12),
    )
    for w, c in seen.items():
        out[98 + zlib.crc32(w.lower().encode()) % BUCKETS] += c / n
    return out


def metadata(source: str | None, lang: str | None, size: int | None, lines: int) -> np.ndarray:
    """Features of the metadata view."""
    out = np.zeros(META + 4, dtype=np.float32)
    names = (f"s {source or ''}", f"l {lang or ''}", f"{source or ''} {lang or ''}")
    for name in names:
        out[zlib.crc32(name.encode()) % META] += 1
    size = max(0, size or 0)
    out[META:] = (np.log1p(size) / 12, np.log1p(lines) / 8, min(1.0, size / (lines + 1) / 2000), float(size < 200))
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass(frozen=True)
class Model:
    """Weights of both views, each view's calibration (slope, offset), and of the combination."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = [_logit(x, w) * c[0] + c[1] for x, w, c in zip((a, b), self.views, self.calibration, strict=True)]
        return 1 / (1 + np.exp(-_logit(np.stack(z, axis=1), self.combined)))


#: A round of one view: its weights and the logits up to which and from which on it is sure of 0 and of 1.
Round = tuple[np.ndarray, float, float]


def pseudo_labels(x: np.ndarray, history: list[Round]) -> np.ndarray:
    """What a view's rounds so far have labelled rows: 0, 1, or nan; a label stays."""
    out = np.full(len(x), np.nan)
    for w, low, high in history:
        z, new = _logit(x, w), np.isnan(out)
        out[new & (z <= low)] = 0.0
        out[new & (z >= high)] = 1.0
    return out


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of weighted rows at weights w, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def _step(w: np.ndarray, gradient: np.ndarray, second: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    return w + np.linalg.solve(second + np.diag(penalty), gradient - penalty * w)


class Unlabelled:
    """The stored features (a, b) of all unlabelled rows, wherever they lie."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _map(self, work: Callable[[np.ndarray, np.ndarray], list], shape: str) -> DataFrame:
        names = [c.split()[0] for c in shape.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1) for c in ("a", "b"))
                    yield pa.RecordBatch.from_arrays(work(a, b), names)

        return self.rows.mapInArrow(run, shape)

    def thresholds(self, views: list[np.ndarray], history: list[list[Round]], low: float, high: float) -> list[tuple[float, float] | None]:
        """For each view the logits below and above which shares of the rows lie that it has not labelled yet."""

        def work(a: np.ndarray, b: np.ndarray) -> list:
            left = (np.where(np.isnan(pseudo_labels(x, h)), _logit(x, w), np.nan) for x, h, w in zip((a, b), history, views, strict=True))
            return [pa.array(z, pa.float64(), from_pandas=True) for z in left]

        got = self._map(work, "z0 double, z1 double").agg(*(F.percentile_approx(z, [low, high], 10_000).alias(z) for z in ("z0", "z1"))).first()
        return [tuple(got[z]) if got[z] else None for z in ("z0", "z1")]

    def sums(self, views: list[np.ndarray], history: list[list[Round]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the gradient and second derivatives over the rows that the other view has labelled."""
        sizes = [len(w) for w in views]

        def add(parts: Iterator[np.ndarray]) -> np.ndarray:
            return sum(parts, np.zeros(sum(n + n * n for n in sizes)))

        def work(a: np.ndarray, b: np.ndarray) -> list:
            out = []
            for x, other, w, h in zip((a, b), (b, a), views, history[::-1], strict=True):
                y = pseudo_labels(other, h)
                some = ~np.isnan(y)
                out += [m.ravel() for m in _sums(x[some], y[some], np.full(int(some.sum()), PSEUDO), w)]
            return [pa.array([np.concatenate(out).tobytes()], pa.binary())]

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (np.frombuffer(x) for batch in batches for x in batch.column("s").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([add(rows).tobytes()], pa.binary())], ["s"])

        # Sums of tasks, added up in a few more before the driver adds those.
        parts = self._map(work, "s binary").mapInArrow(merged, "s binary").repartition(8).mapInArrow(merged, "s binary").collect()
        flat, out = add(np.frombuffer(r["s"]) for r in parts), []
        for n in sizes:
            out.append((flat[:n], flat[n : n + n * n].reshape(n, n)))
            flat = flat[n + n * n :]
        return out


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, free: Unlabelled | None, rounds: int = ROUNDS, added: float = ADDED) -> Model:
    """Both views from labelled rows (a, b, y) and unlabelled ones, by exchange of confident labels."""
    aside = np.arange(len(y)) % 4 == 3
    if min(y[aside].sum(), (1 - y[aside]).sum(), y[~aside].sum(), (1 - y[~aside]).sum()) < 1:
        aside = np.zeros(len(y), dtype=bool)
    check = aside if aside.any() else ~aside
    labelled, own = (a[~aside], b[~aside]), y[~aside]
    ones, share = np.ones(len(own)), float(own.mean())
    views = [np.zeros(x.shape[1] + 1) for x in labelled]
    history: list[list[Round]] = [[], []]
    for step in range(rounds + 1):
        for _ in range(STEPS if step else FIRST_STEPS):
            more = free.sums(views, history) if step else [(0.0, 0.0)] * 2
            known = [_sums(x, own, ones, w) for x, w in zip(labelled, views, strict=True)]
            views = [_step(w, g + m, h + n) for w, (g, h), (m, n) in zip(views, known, more, strict=True)]
        if step == rounds or free is None:
            break
        found = free.thresholds(views, history, added * (1 - share), 1 - added * share)
        for v, at in enumerate(found):
            if at is not None:
                history[v].append((views[v], min(at[0], -1.0), max(at[1], 1.0)))
    seen = (a[check], b[check])
    calibration = tuple(_fit(_logit(seen[v], views[v])[:, None], y[check], np.ones(int(check.sum()))) for v in (0, 1))
    z = np.stack([_logit(seen[v], views[v]) * calibration[v][0] + calibration[v][1] for v in (0, 1)], axis=1)
    return Model((views[0], views[1]), calibration, _fit(z, y[check], np.ones(len(z))))


def _columns(docs: DataFrame) -> DataFrame:
    """What the views read, whatever else ``docs`` holds."""
    text = F.col("text").cast("string").alias("text")
    return docs.select("doc_id", text, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars"))


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in part.column("text").to_pylist()]
    rest = zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), texts, strict=True)
    return np.stack([content(t) for t in texts]), np.stack([metadata(s, g, n, t.count("\n")) for s, g, n, t in rest])


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): both views' features of each row as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = [pa.array([x.tobytes() for x in v], pa.binary()) for v in _views(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *rows], ["doc_id", "a", "b"])

    return _columns(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, a binary, b binary")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """The model from a bounded sample of labelled rows, whose features reach the driver, and all unlabelled rows.

    A document whose labels disagree teaches nothing and is not unlabelled either; one whose rows differ counts with the least features."""
    spark = docs.sparkSession
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (crc % 3 != 1))
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    known = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(labelled))
    found = _features(docs.join(known.select("doc_id"), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("f"))
    got = found.select("doc_id", "f.a", "f.b").join(known, "doc_id").orderBy("doc_id").toArrow()
    y = got.column("y").to_numpy()
    if not (y == 0).any() or not (y == 1).any():
        return None
    a, b = (np.stack([np.frombuffer(x, dtype=np.float32) for x in got.column(c).to_pylist()]) for c in ("a", "b"))
    every, free = shared_dir(spark), shared_dir(spark)
    try:
        _features(docs.filter(crc % 3 != 1)).write.option("compression", "zstd").parquet(every)
        spark.read.parquet(every).join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("a", "b").write.option("compression", "zstd").parquet(free)
        rows = spark.read.parquet(free)
        return co_train(a, b, y.astype(float), None if rows.isEmpty() else Unlabelled(rows))
    finally:
        for path in (every, free):
            remove(spark, path)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document: likelihood of quality 1, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in byte_slices(batch, "text"):
                s = m.score(*_views(part)) if m else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return _columns(docs).mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(crc % 3 == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
