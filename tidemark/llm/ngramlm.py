"""Stupid-backoff language-model scores from count tables that are partitioned by hash.

Words are runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII.  A document's score is the sum
over its words of log S.  For a word with its k - 1 predecessors, k at most ``order`` and never reaching over the
document's begin, S is c(k words) / c(the first k - 1 of them) if the k words occur in the training text, else
``alpha`` times S of the last k - 1 words; for one word S = c(word) / N, where N counts all words and an unseen word counts
once.  A document of the training text itself is scored by what is left without it: all counts are those of the
whole text less the document's own, so an n-gram that no other document holds is backed off from.

The computation is a join of exploded n-grams with count tables, its rows packed into arrays.  Documents are staged in
blocks of about ``BLOCK_BYTES``.  A block explodes into its distinct n-grams, as sorted 64-bit hashes with counts,
dealt over buckets of equal ranges of hashes; a bucket adds up its part of the count table, joins it with each block's
n-grams, and answers which of them occur elsewhere and how often.  Blocks and answers meet by block, where every
document's own counts are taken off and its logarithms summed.  What one bucket receives for an n-gram is a row's entry for
each block, however frequent the n-gram is, and every size of corpus takes this one path.

Defined cases: a null or empty text has no words and score 0; repeated rows each count and each get a row (the other
copies are then training text); with no other text N counts as 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import MOST_SHARDS, WORDS, byte_slices, remove, shard_of, shared_dir, texts_of

ALPHA = 0.4
ORDER = 3
BLOCK_BYTES = 8 << 20
#: N-grams of one order of all blocks for one hash bucket.
BUCKET_GRAMS = 1 << 22
#: Bytes of the rows that a task holds while it writes them to a table of its own.
ROW_GROUP = 4 * BLOCK_BYTES
#: N-grams of a bucket that are added up at once.
SLICE_GRAMS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the texts' words, one text after the other, and where each text begins and ends."""
    import xxhash

    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :] if len(texts) else np.zeros(1, np.int32)
    raw = (data[int(at[0]) : int(at[-1])].to_pybytes() if data is not None else b"").translate(WORDS)
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw)])
    split = pa.compute.ascii_split_whitespace(plain)
    numbered = split.flatten().dictionary_encode()
    words, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    there = np.fromiter(map(bool, words), dtype=bool, count=len(words))[number]  # blanks at the ends leave empty words
    ends = np.concatenate(([0], np.cumsum(there)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return each[number[there]], ends


def mixed(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams one word longer."""
    x = (before ^ (before >> np.uint64(29))) * _MIX + words
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(texts: pa.Array, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the hashes of all n-grams and the numbers of the words that end them; and the texts' ends.

    No n-gram reaches over the begin of its text."""
    words, ends = word_hashes(texts)
    place = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
    out, last, h = [], np.arange(len(words)), words
    for k in range(order):
        if k:
            keep = place[last] >= k
            h, last = mixed(h[np.searchsorted(last, last[keep] - 1)], words[last[keep]]), last[keep]
        out.append((h, last))
    return out, ends


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the planes of small numbers compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the part of each bucket begins and ends among sorted hashes."""
    width = (1 << 64) // buckets + 1
    return np.concatenate((np.searchsorted(hashes, np.array([k * width for k in range(buckets)], dtype=np.uint64)), [len(hashes)]))


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


@contextmanager
def _session(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the queries inside."""
    names = {k: f"spark.sql.{k.replace('__', '.')}" for k in settings}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, v in settings.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)


class _Tables:
    """Tables written along the way, removed at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        # Rows may be megabytes: the writer looks at each one whether a group of rows is full, by default only at every hundredth.
        groups = {"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
        df.write.options(compression="zstd", **groups).parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def remove(self) -> None:
        for path in self.paths:
            remove(self.spark, path)


def _blocks(df: DataFrame) -> DataFrame:
    """(block, ids, texts, words): documents in blocks of about ``BLOCK_BYTES``, and how many words those hold."""
    kind = dict(df.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in byte_slices(batch, "text", BLOCK_BYTES):
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("doc_id", "text")]
                n = int(word_hashes(part.column("text"))[1][-1])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([n], pa.int64())], ["block", "ids", "texts", "words"])
                block += 1

    return df.mapInArrow(run, f"block bigint, ids array<{kind}>, texts array<string>, words bigint")


def _asked(blocks: DataFrame, orders: tuple[int, ...], buckets: int, asks: bool, gives: bool) -> DataFrame:
    """(bucket, part, block, asks, h, c): a row for each block, order and bucket with the block's distinct n-grams there,
    sorted, and how often they occur in the block (if its text is training text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
                found, _ = grams(texts.values, max(orders))
                for k in orders:
                    h, c = np.unique(found[k - 1][0], return_counts=True)
                    at = _edges(h, buckets)
                    some = np.flatnonzero(np.diff(at)).tolist()
                    gaps = [planes(np.diff(h[at[b] : at[b + 1]], prepend=np.uint64(0))) for b in some]
                    counts = [planes(c[at[b] : at[b + 1]].astype(np.uint32) * np.uint32(gives)) for b in some]
                    n = len(some)
                    yield _batch(
                        {
                            "bucket": ([b + buckets * orders.index(k) for b in some], pa.int32()), "part": (some, pa.int32()), "k": ([k] * n, pa.int32()),
                            "block": ([block] * n, pa.int64()), "asks": ([asks] * n, pa.bool_()), "h": (gaps, pa.binary()), "c": (counts, pa.binary()),
                        }
                    )

    return blocks.select("block", "texts").mapInArrow(run, "bucket int, part int, k int, block bigint, asks boolean, h binary, c binary")


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: its count table from all blocks' parts, joined to the n-grams of each block that asks.

    (block, k, part, at, x): which n-grams of the block's part occur outside of it, and how often.  The table is added up slice by
    slice of the bucket's hashes, so beside the n-grams themselves a task holds the sums of ``SLICE_GRAMS`` of them."""
    held: dict[int, list[tuple[dict, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            h, c = np.cumsum(unplaned(r.pop("h"), np.uint64), dtype=np.uint64), unplaned(r.pop("c"), np.uint32)
            held.setdefault(r["bucket"], []).append((r, h, c))
    for bucket in sorted(held):
        rows = held.pop(bucket)
        for (r, _, _), (at, x) in zip(rows, outside_counts([h for _, h, _ in rows], [c for _, _, c in rows], [r["asks"] for r, _, _ in rows]), strict=True):
            if len(at):
                gaps = np.diff(at, prepend=np.uint32(0)).astype(np.uint32)
                yield _batch(
                    {
                        "block": ([r["block"]], pa.int64()), "k": ([r["k"]], pa.int32()), "part": ([r["part"]], pa.int32()),
                        "at": ([planes(gaps)], pa.binary()), "x": ([planes(x.astype(np.uint64))], pa.binary()),
                    }
                )


def outside_counts(hashes: list[np.ndarray], counts: list[np.ndarray], asks: list[bool]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list of distinct sorted hashes that asks: the places of those that other lists count too, and their counts there.

    Hashes are even over their range, so slices of equal width hold about as many."""
    lists = [h for h in hashes if len(h)]
    least, most = (int(min(h[0] for h in lists)), int(max(h[-1] for h in lists))) if lists else (0, 0)
    n = max(1, -(-sum(map(len, hashes)) // SLICE_GRAMS))
    bounds = np.array([least + (most - least + 1) * j // n for j in range(1, n)], dtype=np.uint64)
    cuts = [np.concatenate(([0], np.searchsorted(h, bounds), [len(h)])) for h in hashes]
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in hashes]
    for j in range(n):
        parts = [slice(cut[j], cut[j + 1]) for cut in cuts]
        own = np.concatenate([c[p] for c, p in zip(counts, parts, strict=True)])
        _, number = np.unique(np.concatenate([h[p] for h, p in zip(hashes, parts, strict=True)]), return_inverse=True)
        outside = np.bincount(number, weights=own).astype(np.int64)[number] - own
        start = 0
        for out, p, asking in zip(found, parts, asks, strict=True):
            x = outside[start : start + p.stop - p.start]
            start += len(x)
            at = np.flatnonzero(x) if asking else []
            if len(at):
                out.append(((at + p.start).astype(np.uint32), x[at]))
    none = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    return [tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else none for out in found]


def block_scores(texts: pa.Array, answers: list[dict], order: int, buckets: int, total: int, alpha: float, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words, scores) of a block's texts.  ``left_out``: the texts are training text, and each one's own counts come off."""
    found, ends = grams(texts, order)
    size = np.diff(ends)
    doc = np.repeat(np.arange(len(size)), size)
    n = len(doc)
    counts = []
    for k, (h, last) in enumerate(found, 1):
        distinct, number, c = np.unique(h, return_inverse=True, return_counts=True)
        outside, edges = np.zeros(len(distinct), dtype=np.int64), _edges(distinct, buckets)
        for r in answers:
            if r["k"] == k:
                at = np.cumsum(unplaned(r["at"], np.uint32), dtype=np.int64)
                outside[edges[r["part"]] + at] = unplaned(r["x"], np.uint64).astype(np.int64)
        here = outside[number]
        if left_out:
            _, pair, times = np.unique(doc[last] * max(1, len(distinct)) + number, return_inverse=True, return_counts=True)
            here = here + c[number] - times[pair]
        full = np.zeros(n, dtype=np.int64)
        full[last] = here
        counts.append(full)
    most = np.minimum(np.arange(n) - np.repeat(ends[:-1], size) + 1, order)
    all_words = np.maximum(total - size * left_out, 1)
    s = np.log(np.maximum(counts[0], 1)) - np.log(np.repeat(all_words, size)) + (most - 1) * np.log(alpha)
    for k in range(2, order + 1):
        seen = np.flatnonzero(counts[k - 1])
        s[seen] = np.log(counts[k - 1][seen]) - np.log(counts[k - 2][seen - 1]) + (most[seen] - k) * np.log(alpha)
    sums = np.concatenate(([0.0], np.cumsum(s)))
    return size, np.where(size > 0, np.add.reduceat(np.append(s, 0.0), np.minimum(ends[:-1], n)), 0.0) if len(size) else sums[:0]


def _task_bounds(blocks: DataFrame, most: int = MOST_SHARDS) -> list[int]:
    """The blocks at which a new scoring task begins: a task for each block, or ``most`` tasks of as many blocks each.

    A task sorts its blocks and holds one at a time, so more blocks take it longer, not more memory.
    """
    n = blocks.count()
    k = min(n, most)
    if k < 2:
        return []
    first = [i / k + 0.5 / n for i in range(1, k)]
    return sorted(set(blocks.agg(F.percentile_approx("block", first, max(10_000, 4 * k)).alias("at")).first()["at"]))


def _scored(order: int, buckets: int, total: int, alpha: float, left_out: bool) -> Callable:
    """Rows sorted by block, the block's documents first, to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []

        def done() -> pa.RecordBatch:
            size, score = block_scores(held[2], answers, order, buckets, total, alpha, left_out)
            return pa.RecordBatch.from_arrays([held[1], pa.array(size, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_words", "score"])

        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if held is not None and held[0] != block:
                    yield done()
                    held, answers = None, []
                if batch.column("k")[i].as_py() == 0:
                    held = (block, batch.column("ids")[i].values, batch.column("texts")[i].values)
                else:
                    answers.append({c: batch.column(c)[i].as_py() for c in ("k", "part", "at", "x")})
        if held is not None:
            yield done()

    return run


def score(docs: DataFrame, train: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score) of each document under the counts of ``train``, or of all other documents of ``docs``.

    Each pass over the blocks asks for some orders, and its shuffle is given up when its answers are written, so the
    disk holds one pass at a time.
    """
    df = texts_of(docs, id_col, text_col)
    spark, kind = df.sparkSession, dict(df.dtypes)["doc_id"]
    tables = _Tables(spark)
    cleanup = {"classic__shuffleDependency__fileCleanup__enabled": "true"}
    try:
        with _session(spark, **cleanup):
            blocks = tables.write(_blocks(df))
            known = blocks if train is None else tables.write(_blocks(texts_of(train, id_col, text_col)))
        total = known.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        every = total if train is None else total + blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), every // BUCKET_GRAMS + 1)
        answers = None
        # A block is a row of several megabytes: neither reader nor Python gets more than some at once.
        with _session(spark, **cleanup, execution__arrow__maxRecordsPerBatch="4", parquet__columnarReaderBatchSize="4"):
            for orders in [(1, 2)[:order], *((k,) for k in range(3, order + 1))]:
                asked = _asked(blocks, orders, buckets, True, train is None)
                if train is not None:
                    asked = asked.unionByName(_asked(known, orders, buckets, False, True))
                dealt = asked.repartitionById(buckets * len(orders), "bucket")
                got = tables.write(dealt.mapInArrow(_answered, "block bigint, k int, part int, at binary, x binary"))
                answers = got if answers is None else answers.unionByName(got)
            both = blocks.drop("words").withColumn("k", F.lit(0)).unionByName(answers, allowMissingColumns=True)
            bounds = _task_bounds(blocks)
            own = both.withColumn("task", shard_of(bounds)("block")).repartitionById(len(bounds) + 1, "task").drop("task")
            sorted_rows = own.sortWithinPartitions("block", "k", "part")
            result = sorted_rows.mapInArrow(_scored(order, buckets, total, alpha, train is None), f"doc_id {kind}, n_words bigint, score double")
            path = shared_dir(spark)
            result.write.parquet(path)
        return spark.read.schema(result.schema).parquet(path)
    finally:
        tables.remove()


def op1(docs: DataFrame) -> DataFrame:
    """Each document's score under all other documents and its score for a word, rounded to four and six digits."""
    each = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return score(docs).select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(each, 6).alias("score_per_word"))


_SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPLIT}'), []) AS w FROM documents
), t AS (SELECT sum(len(w)) AS n FROM d
), p AS (SELECT r, len(w) AS l, w, unnest(range(1, len(w) + 1)) AS p FROM d
), g AS (SELECT r, l, p, w[p] AS w, CASE WHEN p > 1 THEN w[p - 1] END AS v, CASE WHEN p > 2 THEN w[p - 2] END AS u FROM p
), c AS (
  SELECT r, l, p, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS c1,
         CASE WHEN p > 1 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) END AS c2,
         CASE WHEN p > 2 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) END AS c3
  FROM g
), b AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY p) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY p) AS b2 FROM c
), s AS (
  SELECT r, sum(CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) + CASE WHEN p > 2 THEN ln({ALPHA}) ELSE 0 END
                     ELSE ln(greatest(c1, 1) / greatest(t.n - l, 1)) + least(p - 1, 2) * ln({ALPHA}) END) AS score
  FROM b, t GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS score,
       CASE WHEN len(w) > 0 THEN round(score / len(w), 6) END AS score_per_word
FROM d LEFT JOIN s USING (r)
"""
