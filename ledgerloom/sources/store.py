"""Tables that a stream writes batch by batch and shows by one commit record.

Rows of a table lie in hash buckets of its key, a folder for each batch and bucket. What the tables hold is
named by the newest commit record alone: for every table and bucket the folders that make it up. A batch writes
all its folders first and its record last, so readers see all of a batch or nothing. A batch that is delivered
again after a crash overwrites its own folders; one that was committed is known by its record.

A later batch reads only the buckets its keys fall in. A bucket that has gathered many folders is rewritten as
one, so the number of folders, and with it the record, stays bounded.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Folders of a bucket before they are rewritten as one.
FOLDERS = 8
#: Commit records kept: readers may hold an older one for a while.
RECORDS = 16


@dataclass(frozen=True)
class Table:
    """Columns of a table and the one whose hash deals its rows into buckets."""

    key: str
    schema: str


@dataclass(frozen=True)
class Commit:
    """Newest state of all tables: folders by table and bucket."""

    batch: int
    folders: dict[str, dict[int, list[str]]]


def _ddl(schema: str) -> StructType:
    return StructType.fromDDL(schema)


class Store:
    """A set of tables below one folder."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = BUCKETS, folders: int = FOLDERS):
        self.spark, self.root, self.tables, self.buckets, self.folders = spark, root.rstrip("/"), tables, buckets, folders
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ commit records
    def _records(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def last(self) -> Commit:
        known = self._records()
        if not known:
            return Commit(-1, {name: {} for name in self.tables})
        lines = self.spark.read.text(f"{self.root}/commits/{known[-1]:012d}.json", wholetext=True).first()
        folders = json.loads(lines[0])
        return Commit(known[-1], {name: {int(b): f for b, f in folders.get(name, {}).items()} for name in self.tables})

    def _record(self, commit: Commit) -> None:
        """The record appears whole: it is written aside and renamed."""
        at, aside = f"{self.root}/commits/{commit.batch:012d}.json", f"{self.root}/commits/{commit.batch:012d}.part"
        out = self._fs.create(self._path(aside), True)
        out.write(bytearray(json.dumps(commit.folders).encode()))
        out.close()
        if not self._fs.rename(self._path(aside), self._path(at)):
            raise OSError(f"cannot write {at}")
        for old in self._records()[:-RECORDS]:
            self._fs.delete(self._path(f"{self.root}/commits/{old:012d}.json"), False)

    # -------------------------------------------------------------------- reading
    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets that the rows' keys fall in: at most as many values as there are buckets."""
        return [r[0] for r in rows.select(self.bucket(F.col(key)).alias("b")).distinct().collect()]

    def read(self, name: str, buckets: list[int] | None = None, commit: Commit | None = None) -> DataFrame:
        """Rows of a table as committed, of some buckets or of all."""
        held = (commit or self.last()).folders[name]
        paths = [f"{self.root}/{name}/{folder}/bucket={b}" for b, folders in sorted(held.items()) if buckets is None or b in buckets for folder in folders]
        return self._at(name, paths)

    def _at(self, name: str, paths: list[str]) -> DataFrame:
        schema = _ddl(self.tables[name].schema)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -------------------------------------------------------------------- writing
    def begin(self, batch: int) -> Batch | None:
        """The batch to write, or None if it is committed already."""
        last = self.last()
        return Batch(self, batch, last) if batch > last.batch else None


class Batch:
    """What one batch writes; nothing of it counts before ``commit``."""

    def __init__(self, store: Store, number: int, before: Commit):
        self.store, self.number, self.before = store, number, before
        self.folders = {name: {b: list(f) for b, f in held.items()} for name, held in before.folders.items()}

    def _write(self, name: str, rows: DataFrame, folder: str) -> list[int]:
        """Rows dealt into bucket folders; a crowded bucket is written by several tasks."""
        table, at = self.store.tables[name], f"{self.store.root}/{name}/{folder}"
        fields = _ddl(table.schema)
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        dealt = typed.withColumn("bucket", self.store.bucket(F.col(table.key))).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(at)
        names = [f.getPath().getName() for f in self.store._fs.listStatus(self.store._path(at))]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows to a table; returns them as stored."""
        folder = f"{self.number:012d}"
        written = self._write(name, rows, folder)
        for b in written:
            self.folders[name].setdefault(b, []).append(folder)
        return self.store._at(name, [f"{self.store.root}/{name}/{folder}/bucket={b}" for b in written])

    def replace(self, name: str, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Whole new content of some buckets of a table; returns it as stored."""
        folder = f"{self.number:012d}"
        written = self._write(name, rows, folder)
        for b in buckets:
            self.folders[name].pop(b, None)
        for b in written:
            self.folders[name][b] = [folder]
        return self.store._at(name, [f"{self.store.root}/{name}/{folder}/bucket={b}" for b in written])

    def known(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """What the table held before this batch in the buckets that the rows' keys fall in."""
        return self.store.read(name, self.store.touched(rows, key), self.before)

    def commit(self) -> None:
        """Rewrite crowded buckets as one folder, then show the batch by its record."""
        for name, held in self.folders.items():
            full = [b for b, folders in held.items() if len(folders) > self.store.folders]
            if full:
                rows = self.store.read(name, full, Commit(self.number, self.folders))
                folder = f"{self.number:012d}-merged"
                for b in self._write(name, rows, folder):
                    held[b] = [folder]
        self.store._record(Commit(self.number, self.folders))
