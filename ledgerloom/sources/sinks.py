"""File source and ledger sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that ``write_files`` deals files to.
SENT_FOLDERS = 256
# Contents that a task which opens files holds at once, and such tasks for each core.
HELD_BYTES = 16 << 20
TASKS_A_CORE = 4

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"
_NOTICE = "folder string, file_id long"


def _named(binary: DataFrame) -> DataFrame:
    return binary.select(
        "path", F.substring_index("path", "/", -1).alias("filename"),
        F.col("modificationTime").alias("received_at"),
        "content",
    )


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.sha2("path", 256).alias("doc_id"), "filename", "declared_mime", "received_at",
        F.coalesce("content", F.lit(b"")).alias("content"),
    )


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files as they arrive in a folder tree, in the shape ``audit_files`` reads."""
    arriving = (
        spark.readStream.format("binaryFile").schema(_BINARY)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return _keyed(_named(arriving).withColumn("declared_mime", F.lit(None).cast("string")))


def read_files(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Files of a folder tree in the shape ``audit_files`` reads; the id is a hash of the full path.

    Spark's file source passes over files without a single byte. A manifest
    (path, declared_mime) of what was sent brings those back as empty files
    and adds the declared types; without one they cannot be seen. A repeated path counts once.
    """
    found = _named(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    if manifest is None:
        rows = found.withColumn("declared_mime", F.lit(None).cast("string"))
    else:
        sent = manifest.groupBy("path").agg(F.min("declared_mime").alias("declared_mime"))
        rows = found.join(sent, "path", "full").withColumn("filename", F.substring_index("path", "/", -1))
    return _keyed(rows)


def _mounted(path: str) -> str | None:
    """The folder of a path that tasks can open themselves, else None."""
    place = urlsplit(path)
    if place.scheme not in ("", "file"):
        return None
    return unquote(place.path) if place.scheme else path


def _notices(path: str) -> str:
    """Where ``write_files`` names the files it has written: a row of ids each, not an entry of the driver's."""
    return f"{path.rstrip('/')}-notices"


def _put_files(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes (folder, file_id, content) rows below a mounted path; a file is seen whole or not at all."""

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file_id, content in zip(*[column.to_pylist() for column in batch.columns]):
                at = os.path.join(path, folder)
                os.makedirs(at, exist_ok=True)
                unready = os.path.join(at, f".{file_id}-{uuid.uuid4().hex}")
                with open(unready, "wb") as out:
                    out.write(content)
                os.replace(unready, os.path.join(at, f"file_id={file_id}"))
            yield batch.select(["folder", "file_id"])

    return put


def _list_folders(path: str, folders: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The files (folder, file_id) of the folders with the given positions."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in (folders[at] for at in batch.column(0).to_pylist()):
                names = os.listdir(os.path.join(path, folder))
                ids = [int(name.removeprefix("file_id=")) for name in names if name.startswith("file_id=")]
                yield pa.RecordBatch.from_pydict({"folder": pa.array([folder] * len(ids), pa.string()), "file_id": pa.array(ids, pa.int64())})

    return found


def _get_files(path: str, held: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds contents to rows that begin with (folder, file_id), about ``held`` bytes at once; no folder, no content."""

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, size, done = [], 0, 0
            for at, (folder, file_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), start=1):
                content = None
                if folder is not None:
                    with open(os.path.join(path, folder, f"file_id={file_id}"), "rb") as file:
                        content = file.read()
                    size += len(content)
                contents.append(content)
                if size >= held or at == batch.num_rows:
                    part = batch.slice(done, at - done)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])
                    contents, size, done = [], 0, at

    return get


def write_files(files: DataFrame, path: str) -> None:
    """Contents (file_id, content) as one file each, ids being unique; empty contents have no file.

    Below a mounted folder the tasks write them, dealt to ``SENT_FOLDERS`` folders, and what they have written is named
    in a table beside it, which shows the files of finished tasks only. On any other file system the text sink does,
    a folder each; it ends what it writes with a line feed, so there contents must end with one.
    """
    held = files.filter("octet_length(content) > 0 AND file_id IS NOT NULL")
    at = _mounted(path)
    if at is not None:
        os.makedirs(at, exist_ok=True)
        folder = F.pmod(F.hash("file_id"), F.lit(SENT_FOLDERS)).cast("string")
        dealt = held.select(folder.alias("folder"), F.col("file_id").cast("long").alias("file_id"), "content")
        dealt.mapInArrow(_put_files(at), _NOTICE).write.mode("append").parquet(_notices(path))
        return
    body = F.expr("CAST(substring(content, 1, octet_length(content) - 1) AS STRING)")
    held.select("file_id", body.alias("value")).write.partitionBy("file_id").text(path)


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("file_id").alias("doc_id"), "filename", "declared_mime", "received_at", F.coalesce("content", F.lit(b"")).alias("content"))


def _sent(found: DataFrame, manifest: DataFrame, how: str) -> DataFrame:
    file_id = F.regexp_extract("path", r"/file_id=(-?\d+)", 1).cast("long")
    return _shaped(found.select(file_id.alias("file_id"), "content").join(manifest, "file_id", how))


def _opened(found: DataFrame, manifest: DataFrame, how: str, path: str) -> DataFrame:
    """Files (folder, file_id) meet the manifest by their ids alone; then the tasks open them, so no content is shuffled.

    Spark takes a list of files for as small as the table of folders, hence the hint. The rows are small, too, for the
    bytes they stand for: their tasks are counted, as Spark would merge them.
    """
    spark = found.sparkSession
    named = found.hint("merge").join(manifest, "file_id", how).select("folder", "file_id", "filename", "declared_mime", "received_at")
    dealt = named.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "file_id")
    schema = T.StructType([*dealt.schema.fields, T.StructField("content", T.BinaryType())])
    return _shaped(dealt.mapInArrow(_get_files(path, HELD_BYTES), schema))


def read_sent(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """What ``write_files`` wrote, with the names and types of a manifest (file_id, filename, declared_mime, received_at).

    Files of the manifest that are not there were empty. Below a mounted folder the tasks list the files, a folder
    each: the driver holds the names of folders only. Of any other file system Spark's driver lists every file.
    """
    at = _mounted(path)
    if at is None:
        return _sent(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), manifest, "right")
    folders = sorted(os.listdir(at))
    listed = spark.range(0, len(folders), 1, max(len(folders), 1)).mapInArrow(_list_folders(at, folders), _NOTICE)
    return _opened(listed, manifest, "right", at)


def sent_stream(
    spark: SparkSession, path: str, manifest: DataFrame, files_per_batch: int = 10_000, notices_per_batch: int = 16
) -> DataFrame:
    """The same as files arrive; empty ones never do.

    Below a mounted folder the stream follows what ``write_files`` has named, ``notices_per_batch`` of its tasks at
    once, and the tasks open the files. Spark's file source keeps every path it has seen on the driver.
    """
    at = _mounted(path)
    if at is not None:
        named = spark.readStream.schema(_NOTICE).option("maxFilesPerTrigger", notices_per_batch).parquet(_notices(path))
        return _opened(named, manifest, "inner", at)
    arriving = (
        spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return _sent(arriving, manifest, "inner")


def write_dated(rows: DataFrame, path: str, stamp: str = "created_at", batch: str = "0") -> None:
    """Parquet below ``year=/month=/batch=`` folders, so date filters prune whole folders.

    A batch that is written again replaces its own folders, so a rerun adds nothing; other batches stay.
    """
    (
        rows.withColumns({"year": F.year(stamp), "month": F.month(stamp), "batch": F.lit(batch)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "batch").parquet(path)
    )


def read_dated(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches with their year and month."""
    return spark.read.parquet(path).drop("batch")


def write_bucketed(rows: DataFrame, name: str, path: str, keys: tuple[str, ...], buckets: int = 64) -> DataFrame:
    """A table whose files are dealt by the keys: joins and aggregates on the keys need not shuffle it."""
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return rows.sparkSession.table(name)
