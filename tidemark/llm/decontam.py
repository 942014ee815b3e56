"""Benchmark decontamination: broadcast windows of benchmark words, scan documents, cut hits.

A word is a run of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII.
A window is ``window`` consecutive words of one benchmark item; an item of fewer words is one
window.  Windows are a fixed query set: they are broadcast in blocks of at most ``block_windows``
distinct windows, one block at a time, and every document is scanned against every block: with more than
one, each pass reads the staged documents and leaves its hits as a table, so neither the driver nor a worker
ever holds two blocks.  Inside a task words become vocabulary numbers, windows become rolling
hashes over them, and each hash hit is verified against the window itself.

Defined cases: null or empty texts have no words and no hits; repeated documents give repeated
rows; an item with a null id marks words as hit but names no item; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORDS, free_name, map_texts, texts_of, written

WINDOW = 10
BLOCK_WINDOWS = 200_000
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    if len(words) <= window:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win binary, items array<string>): the distinct windows and the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))

    def make() -> Callable:
        return lambda texts: [pa.array([sorted(set(windows_of(words_of(t), window))) for t in texts], pa.list_(pa.binary()))]

    return (
        map_texts(items, make, "wins array<binary>")
        .select("item", F.explode("wins").alias("win"))
        .groupBy("win")
        .agg(F.collect_set("item").alias("items"))
    )


class _Index:
    """One block of windows, ready to scan batches of texts."""

    def __init__(self, block: list[tuple[bytes, list[str]]]):
        split = [(w.split(), items) for w, items in block]
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws, _ in split for w in ws}), 1)}
        self.items = {tuple(self.vocab[w] for w in ws): items for ws, items in split}
        self.hashes = {}
        for size in {len(k) for k in self.items}:
            rows = np.array([k for k in self.items if len(k) == size], dtype=np.uint64)
            self.hashes[size] = np.unique(self._hash(rows, np.arange(0, rows.size, size), size, rows.ravel()))

    @staticmethod
    def _hash(_rows, starts, size, flat):
        h = np.zeros(len(starts), dtype=np.uint64)
        for j in range(size):
            h = h * _BASE + flat[starts + j]
        return h

    def scan(self, docs: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each document with hits: its merged word ranges [start, end) and its items."""
        sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.zeros(int(begin[-1]) + 1, dtype=np.uint64)  # a 0 ends each document
        get = self.vocab.get
        for d, at in zip(docs, begin, strict=False):
            flat[at : at + len(d)] = np.fromiter(map(get, d, repeat(0)), dtype=np.uint64, count=len(d))
        gaps = np.concatenate(([0], np.cumsum(flat == 0)))
        found: dict[int, tuple[list, set]] = {}
        for size, hashes in self.hashes.items():
            if len(flat) < size:
                continue
            starts = np.flatnonzero(gaps[size:] == gaps[:-size])
            h = self._hash(None, starts, size, flat)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for p in starts[hashes[at] == h].tolist():
                items = self.items.get(tuple(flat[p : p + size].tolist()))
                if items is not None:
                    doc = int(np.searchsorted(begin, p, side="right")) - 1
                    ranges, names = found.setdefault(doc, ([], set()))
                    ranges.append((p - int(begin[doc]), p - int(begin[doc]) + size))
                    names.update(items)
        return {d: (merged(r), n) for d, (r, n) in found.items()}


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges that cover the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_cache: dict[str, _Index] = {}


def _index(shared) -> _Index:
    """The block's index, built once for each Python worker; only the last is kept."""
    if shared.value[0] not in _cache:
        _cache.clear()
        _cache[shared.value[0]] = _Index(shared.value[1])
    return _cache[shared.value[0]]


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_windows: int) -> Iterator[Broadcast]:
    """Broadcasts (key, windows with items, whether there are several) of all windows, about ``block_windows`` in each, made one by one."""
    wins = benchmark_windows(benchmark, window).persist()
    try:
        blocks = max(1, -(-wins.count() // block_windows))
        part = F.pmod(F.xxhash64("win"), F.lit(blocks))
        for k in range(blocks):
            rows = [(bytes(r["win"]), list(r["items"])) for r in wins.filter(part == k).collect()]
            yield docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows, blocks > 1))
    finally:
        wins.unpersist()


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, hits array<struct<start,end>> (word positions, end
    exclusive, disjoint, ascending), items array<string> (sorted item ids).

    One pass over the rows in place and no shuffle, if one block holds all windows.
    """
    df = texts_of(docs, id_col, text_col)
    shape = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"
    staged, passes = None, []
    for shared in _blocks(docs, benchmark, window, block_windows):

        def make(shared=shared) -> Callable:
            index = _index(shared)

            def helper(texts: list[str]) -> list:
                words = [words_of(t) for t in texts]
                found = index.scan(words)
                none: tuple = ([], set())
                rows = [found.get(i, none) for i in range(len(texts))]
                return [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in r] for r, _ in rows],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                    pa.array([sorted(n) for _, n in rows], pa.list_(pa.string())),
                ]

            return helper

        if not shared.value[2]:
            return map_texts(df, make, shape)
        staged = written(df.withColumn("rid", F.monotonically_increasing_id())) if staged is None else staged
        found = map_texts(staged, make, shape)
        passes.append(written(found if not passes else found.filter(F.size("hits") > 0)))
        shared.unpersist()
    # The first pass has a row for each document, the others have those that they hit.
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    one = hits.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return one.select("doc_id", "n_words", _disjoint("hits"), "items")


def _disjoint(ranges: str) -> Column:
    """Ranges that may meet or overlap, merged into sorted disjoint ones."""
    kind = "array<struct<start:int,end:int>>"

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        meets = (F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))
        return F.when(meets, longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add).alias("hits")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "spans",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    text_col: str = "text",
) -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    mode "spans": the characters from the first to the last word of each hit range go, the parts
    left are joined by a newline, and the text is scanned again until no window of the block is
    left; a document with no word left goes.  mode "documents": a document with any hit goes.
    Documents without a hit stay as they are, texts that are null or have no word included.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"mode {mode!r} is neither spans nor documents")
    columns, df = docs.columns, docs
    as_text, is_gone, made = (free_name(docs, n) for n in ("as_text", "gone", "made"))
    for shared in _blocks(docs, benchmark, window, block_windows):

        def make(shared=shared) -> Callable:
            index = _index(shared)

            def cut(text: str, ranges: list[tuple[int, int]]) -> str:
                while ranges:
                    at = [m.span() for m in _WORD.finditer(text)]
                    parts, last = [], 0
                    for a, b in ranges:
                        parts.append(text[last : at[a][0]])
                        last = at[b - 1][1]
                    text = "\n".join(p for p in (x.strip() for x in [*parts, text[last:]]) if p)
                    ranges = index.scan([words_of(text)]).get(0, ([], None))[0]
                return text

            def helper(texts: list[str]) -> list:
                found = index.scan([words_of(t) for t in texts])
                if mode == "documents":
                    return [pa.array([i in found for i in range(len(texts))]), pa.array([None] * len(texts), pa.string())]
                new = [cut(t, found[i][0]) if i in found else None for i, t in enumerate(texts)]
                gone = [t is not None and not words_of(t) for t in new]
                return [pa.array(gone), pa.array(new, pa.string())]

            return helper

        df = df.withColumn(as_text, F.col(text_col).cast("string"))
        df = map_texts(df, make, f"{is_gone} boolean, {made} string", drop=(as_text,), text=as_text)
        df = df.filter(~F.col(is_gone)).withColumn(text_col, F.coalesce(made, text_col)).select(*columns)
        if shared.value[2]:
            df = written(df)
            shared.unpersist()
    return df


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``scan``: counts of words and hits, and a hash of the items."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, r: s + (r["end"] - r["start"]).cast("bigint"))
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


UPPER, LOWERCASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL = rf"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWERCASE}'), '{_PATTERN}') AS w FROM benchmark
), bl AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS l FROM bw WHERE len(w) > 0
), bwin AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p : p + l - 1], ' ') AS win
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM bl)
), dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWERCASE}'), '{_PATTERN}'), []) AS w
  FROM documents
), dwin AS (
  SELECT r, l, p, array_to_string(w[p : p + l - 1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p
        FROM dw, (SELECT DISTINCT l FROM bwin) WHERE len(w) >= l)
), hit AS (
  SELECT r, p, l, win FROM dwin SEMI JOIN (SELECT DISTINCT l, win FROM bwin) USING (l, win)
), pos AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hit) GROUP BY r
), it AS (
  SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit JOIN bwin USING (l, win) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
