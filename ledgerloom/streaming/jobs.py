"""Streams over arriving documents and job events.

Sinks are idempotent under redelivery: a repeated micro-batch rewrites its own
folders or finds its commit record.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.ingest import MAX_BYTES, audit_files, register_documents, register_jobs
from ledgerloom.operators.lifecycle import EFFECT, JOB, Machine, compose_effects, current_state, fold_events
from ledgerloom.session import few_listing_tasks, fresh_dir
from ledgerloom.sources.store import Store, Table


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A parquet table of the data directory as a file stream."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # A stream reads folders: of the table's one, or of the data directory the file of just this name.
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(os.path.join(sf_dir, f"{name}.parque[t]"))
    )


def run_available(
    stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything that has arrived, micro-batch by micro-batch, then stop."""
    with few_listing_tasks(stream.sparkSession):  # a batch's files are listed under the settings of the caller's session
        query = (
            stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query


def ingest_stream(files: DataFrame, out: str, checkpoint: str, max_bytes: int = MAX_BYTES) -> None:
    """Audit arriving files and register accepted ones with their PENDING job."""

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted = register_documents(audit_files(batch, max_bytes))
        # One folder per batch: a repeated batch overwrites, never appends twice.
        accepted.write.mode("overwrite").parquet(os.path.join(out, "documents", f"batch={batch_id}"))

    run_available(files, write, checkpoint)


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Registered documents and their jobs."""
    documents = spark.read.parquet(os.path.join(out, "documents")).drop("batch")
    return documents, register_jobs(documents)


def event_store(spark: SparkSession, root: str, **options: int) -> Store:
    """Where a stream of job events keeps its log, the effects of each job's periods, and the counts."""
    return Store(spark, root, {
        "events": Table("job_id", "job_id long, event_id long, ts timestamp, kind string, message string, invoice_id long, period string"),
        "effects": Table("job_id", f"job_id long, period string, effect array<{EFFECT}>"),
        "counts": Table("status", "status string, n_jobs long"),
    }, **options)


def fold_batch(store: Store, events: DataFrame, number: int, machine: Machine = JOB, period: str = "day") -> None:
    """Log one batch of events, fold anew the periods it touches, and move the jobs it touches to their new status.

    Late and out-of-order events count at their own time. Of the ledger only the buckets of the batch's jobs are
    read. Counts change by retraction: one less at the old status of a touched job, one more at the new one.
    """
    batch = store.begin(number)
    if batch is None:
        return
    stamped = events.withColumn("period", F.date_format(F.date_trunc(period, F.col("ts")), "yyyyMMddHH"))
    new = batch.append("events", stamped)
    buckets = store.touched(new, "job_id")
    touched = new.select("job_id", "period").distinct()
    logged = store.read("events", buckets, batch.before).unionByName(new).join(touched, ["job_id", "period"], "left_semi")
    folded = fold_events(logged.withColumn("_key", F.struct("job_id", "period")), machine, "_key")
    old = store.read("effects", buckets, batch.before)
    untouched = old.join(touched, ["job_id", "period"], "left_anti")
    effects = batch.replace(
        "effects", untouched.unionByName(folded.select("_key.job_id", "_key.period", "effect")), buckets
    )
    jobs = touched.select("job_id").distinct()

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        state = _state(rows.join(jobs, "job_id", "left_semi"), machine)
        return state.select("status", F.lit(sign).cast("long").alias("n_jobs"))

    moved = store.read("counts", None, batch.before).unionByName(counted(old, -1)).unionByName(counted(effects, 1))
    totals = moved.groupBy("status").agg(F.sum("n_jobs").alias("n_jobs")).filter("n_jobs <> 0")
    batch.replace("counts", totals, list(range(store.buckets)))  # a row per status
    batch.commit()


def _state(effects: DataFrame, machine: Machine) -> DataFrame:
    return current_state(compose_effects(effects, machine, "period"), machine)


def fold_stream(events: DataFrame, store: Store, checkpoint: str, machine: Machine = JOB, period: str = "day") -> None:
    """Fold all arriving events, micro-batch by micro-batch."""
    run_available(events, lambda rows, number: fold_batch(store, rows, number, machine, period), checkpoint)


def folded_state(store: Store, machine: Machine = JOB) -> DataFrame:
    """Current state per job: the effects of its periods composed in order of event time."""
    return _state(store.read("effects"), machine)


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """Output and checkpoint folders for one run, below the shared folder."""
    root = fresh_dir(spark, label)
    return os.path.join(root, "out"), os.path.join(root, "checkpoint")
