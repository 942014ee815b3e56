"""Tables that change by one small file: data folders beside each other, and a commit that names those that count.

``path/data/<batch>-<random>`` holds what one batch wrote; ``path/commits/<batch>.json`` says which folders make up the table after
it.  The commit file appears at once, by a rename that never replaces another, so a reader sees all of a batch or nothing of it.
A batch that died before its commit leaves folders that nothing names; when it runs again it writes new ones.  A batch that is
run again after its commit changes nothing.

One writer at a time, as a streaming query has it.  Commits list folders by a key that is bounded (a year) or, where rows are only
added, name their own batch alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.sinks import upsert


class Committed:
    """One such table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the committed batches, ascending."""
        where, fs = self._at("commits")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit_of(self, batch: int) -> dict[str, dict[str, str]]:
        """The folders of a commit: {part of the table: {key: folder}}."""
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/commits/{batch}.json").first()[1])

    def latest(self) -> dict[str, dict[str, str]]:
        done = self.batches()
        return self.commit_of(done[-1]) if done else {}

    def folder(self, batch: int) -> str:
        """A folder for a batch's rows that no earlier try of it has used."""
        return f"{self.path}/data/{batch}-{uuid.uuid4().hex}"

    def commit(self, batch: int, folders: dict[str, dict[str, str]]) -> bool:
        """Make ``folders`` the table after ``batch``; False if the batch was committed before."""
        target, fs = self._at(f"commits/{batch}.json")
        made, _ = self._at(f"commits/.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            return False
        out = fs.create(made, False)
        out.write(json.dumps(folders, sort_keys=True).encode())
        out.close()
        return bool(fs.rename(made, target))

    def read(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def remove_unnamed(self, keep: int = 2) -> int:
        """Delete data folders that none of the last ``keep`` commits names, and those commits' forerunners; how many went.

        For upserted tables only, whose commits name the whole table; not while a batch is being written.
        """
        done = self.batches()
        named = {f"{self.path}/data/" + x[len(f"{self.path}/data/") :].split("/")[0] for b in done[-keep:] for part in self.commit_of(b).values() for x in part.values()}
        where, fs = self._at("data")
        gone = 0
        for s in fs.listStatus(where) if fs.exists(where) else []:
            if f"{self.path}/data/{s.getPath().getName()}" not in named:
                gone += bool(fs.delete(s.getPath(), True))
        for b in done[:-keep]:
            fs.delete(self._at(f"commits/{b}.json")[0], False)
        return gone


def append_batch(table: Committed, batch: int, parts: dict[str, DataFrame]) -> bool:
    """Add a batch's rows to several parts of a table under one commit: all of them appear, or none."""
    if batch in table.batches():
        return False
    folders = {}
    for name, rows in parts.items():
        folders[name] = {str(batch): table.folder(batch)}
        rows.write.parquet(folders[name][str(batch)])
    return table.commit(batch, folders)


def appended(table: Committed, part: str, schema: StructType) -> DataFrame:
    """All committed rows of a part."""
    return table.read([x for b in table.batches() for x in table.commit_of(b).get(part, {}).values()], schema)


def upsert_batch(table: Committed, batch: int, rows: DataFrame, keys: list[str], by: str, newest: str) -> bool:
    """Merge a batch's rows into a table kept in folders by the column ``by``: only folders whose value the batch has are read,
    and their merged rows are written beside them."""
    done = table.batches()
    if done and done[-1] >= batch:
        return False
    before = table.commit_of(done[-1]).get("rows", {}) if done else {}
    touched = [str(r[by]) for r in rows.select(by).distinct().collect()]
    merged = upsert(table.read([before[x] for x in touched if x in before], rows.schema), rows, keys, newest)
    folder = table.folder(batch)
    # The column stands in the files too, so that a folder can be read alone.
    merged.withColumn("__part", F.coalesce(F.col(by).cast("string"), F.lit("None"))).repartition("__part", *keys).write.partitionBy("__part").parquet(folder)
    return table.commit(batch, {"rows": before | {x: f"{folder}/__part={x}" for x in touched}})


def upserted(table: Committed, schema: StructType) -> DataFrame:
    """The rows of the last commit."""
    return table.read(list(table.latest().get("rows", {}).values()), schema)
