"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handed to a helper at once; bounds a Python worker's memory, never cuts a text.
SLICE_BYTES = 2 << 20

#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: As LOWER; ASCII that is neither digit nor letter becomes a space.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the harness tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of ``docs``: the only columns an operator reads."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def byte_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold about ``most`` bytes at most (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start, total = np.cumsum(sizes), 0, len(sizes)
    while start < total:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    added: str,
    drop: tuple[str, ...] = ("text",),
    text: str = "text",
) -> DataFrame:
    """Apply a text helper to whole Arrow batches.

    ``make()`` runs once for each task and returns a function from a list of texts
    (null texts arrive as "") to the columns that ``added`` (a DDL string) names.  All
    other columns but ``drop`` pass through unchanged.
    """
    keep = [c for c in df.columns if c not in drop]
    new = [f.split()[0] for f in added.split(", ")]
    kept = ", ".join(f"`{n}` {t}" for n, t in df.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        helper = make()
        for batch in batches:
            for part in byte_slices(batch, text):
                out = helper([x or "" for x in part.column(text).to_pylist()])
                arrays = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)], [*keep, *new]
                )

    return df.mapInArrow(run, f"{kept}, {added}" if kept else added)


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder ``spark.checkpoint.dir``.

    Where that setting is missing (tests, local sessions) a temporary folder takes its place;
    a cluster without the setting is an error, since executors do not share local folders.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="tidemark-")
        base = _own_dir
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` or a writer made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most shards of a table: 800 kB of bounds on the driver and in a task.
MOST_SHARDS = 100_000


def shard_bounds(df: DataFrame, col: str, rows: int, most: int | None = None) -> tuple[list[int], dict]:
    """Ascending ids at which a new shard of about ``rows`` rows begins, and counts.

    The bounds are ids that occur, so the first row of each shard is known by its id.  A table of more than ``rows`` times
    ``most`` rows (``MOST_SHARDS``) has larger shards, not more of them: they are sorted and streamed, so what the driver and
    each task hold is bounded by the number of shards.
    """
    n = df.count()
    k = min(most or MOST_SHARDS, max(1, -(-n // rows)))
    at = [i / k for i in range(1, k)]
    pick = F.percentile_approx(col, at, max(10_000, 4 * k)) if at else F.array().cast("array<bigint>")
    got = df.agg(pick.alias("at"), F.min(col).alias("low"), F.max(F.col(col).isNull()).alias("nulls")).first()
    bounds = sorted({int(x) for x in got["at"] or []})
    if bounds and bounds[0] == got["low"] and not got["nulls"]:
        bounds = bounds[1:]
    return bounds, {"rows": n, "low": got["low"], "nulls": bool(got["nulls"])}


def shard_of(bounds: list[int]):
    """Column function: the shard number of an id under ``bounds`` (null ids: shard 0)."""
    edges = np.asarray(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        values = ids.fillna(0).to_numpy(dtype=np.int64)
        found = np.searchsorted(edges, values, side="right").astype(np.int32)
        found[missing] = 0
        return pd.Series(found)

    return shard
