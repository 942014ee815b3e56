"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each new phrase is the longest known one and one more
code point).  The set of phrases is hashed and kept as a minimum-hash signature: ``BINS`` bins by
a hash's high bits, the smallest 32-bit value in each (one-permutation hashing).  Likeness is the
share of bins that agree among those that either signature fills, an estimate of the
phrase sets' Jaccard similarity.

Defined cases: a null text counts as empty; an empty text has an empty signature, which is like
another empty one (1) and unlike any other (0); repeated rows give repeated rows, in the order of
their texts where ids are equal, null ids first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, map_texts, shard_bounds, shard_of, texts_of

BINS = 128
SHARD_ROWS = 4096
_EMPTY = 0xFFFFFFFF


def phrases(text: str) -> set[str]:
    """The dictionary that the incremental parse of a text builds."""
    seen: set[str] = set()
    add, phrase = seen.add, ""
    for c in text:
        phrase += c
        if phrase not in seen:
            add(phrase)
            phrase = ""
    return seen


def signature(text: str) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    found = phrases(text)
    hashes = np.fromiter((h(p) for p in found), dtype=np.uint64, count=len(found))
    out = np.full(BINS, _EMPTY, dtype=np.uint32)
    values = np.minimum((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.uint32(_EMPTY - 1))
    np.minimum.at(out, (hashes >> np.uint64(57)).astype(np.int64), values)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum()) / n if n else 1.0


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint string) for each document, in one pass and without a shuffle."""
    return map_texts(
        texts_of(docs, id_col, text_col),
        lambda: lambda texts: [pa.array([as_text(signature(t)) for t in texts], pa.string())],
        "fingerprint string",
    )


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with a column likeness for its two fingerprint columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (a, b))
            near = [None if p is None or q is None else likeness(from_text(p), from_text(q)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.float64())], [*batch.schema.names, "likeness"])

    shape = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInArrow(run, f"{shape}, likeness double")


def with_next(docs: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text, shard, ahead): documents in shards of consecutive ids, sorted inside them.

    Each shard ends with a copy of the next shard's first row (``ahead`` 1; after the last shard,
    of the first row of all), so every document's successor stands in its own shard.  What is
    copied is one row for each shard; the texts move in one shuffle.
    """
    df = texts_of(docs, "doc_id", "text")
    bounds, stats = shard_bounds(df, "doc_id", rows)
    last = len(bounds)
    main = df.withColumn("shard", shard_of(bounds)("doc_id")).withColumn("ahead", F.lit(0))
    # At most MOST_SHARDS ids, 8 bytes each.
    firsts = df.sparkSession.createDataFrame(pd.DataFrame({"doc_id": pd.Series(bounds, dtype="int64")}), "doc_id bigint")
    opens = df.join(F.broadcast(firsts), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ahead = opens.withColumn("shard", shard_of(bounds)("doc_id") - 1)
    top = df.filter(F.col("doc_id").isNull() if stats["nulls"] else F.col("doc_id") == stats["low"])
    around = top.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("shard", F.lit(last))
    both = main.unionByName(ahead.unionByName(around).withColumn("ahead", F.lit(1)))
    parts = max(last + 1, 1)
    return both.repartitionById(parts, "shard").sortWithinPartitions(
        "shard", "ahead", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))
    )


def op5(docs: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """The contract's comparison of each text with its edited text and with the next text."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (shard, doc_id, text, signature) of the row above
        for batch in batches:
            for part in byte_slices(batch, "text"):
                out = []
                cols = [part.column(c).to_pylist() for c in ("shard", "ahead", "doc_id", "text")]
                for shard, ahead, doc_id, text in zip(*cols, strict=True):
                    text = text or ""
                    sig = signature(text)
                    if before is not None and before[0] == shard:
                        out.append(pair(*before[1:], text, sig))
                    before = None if ahead else (shard, doc_id, text, sig)
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [part.column("doc_id").type, *types[1:]], strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays(arrays, names)

    def pair(doc_id: int, text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        edited_sig = sig if edited == text else signature(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, len(text), digest, as_text(sig), as_text(edited_sig), likeness(sig, edited_sig), likeness(sig, after_sig)

    shape = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, rows).mapInArrow(run, shape)
