"""Results stored once and read many times, in the folder that all executors share, until the block that made them ends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that this driver's queries have named and nobody has removed.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a local session without that setting uses a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix=f"tidemark-{name}-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` as a Parquet table: what several branches of a plan read is computed once and survives lost executors.

    The table stays until ``tidy`` removes it, since the query that reads it runs later.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, every folder that queries have made inside it.  Results must be read or written inside.

        with tidy(spark):
            queries()["screener"](spark, sf_dir).write.parquet(out)
    """
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _made[before:]
