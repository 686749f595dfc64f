"""Streams that write tables in buckets under one commit record: crashes, redelivery, late events, pruning."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle
from ledgerloom.sources import derived, sinks
from ledgerloom.sources.store import Store, Table
from ledgerloom.sources.tables import load
from ledgerloom.streaming import jobs as streams
from ledgerloom.streaming import ledger

AS_OF = "2026-06-01"


@pytest.fixture
def root(spark):
    return os.path.dirname(streams.scratch(spark, "test")[0])


# ------------------------------------------------------------------------ store
def store_of(spark, root, **options):
    return Store(spark, root, {"t": Table("k", "k long, v string"), "u": Table("k", "k long, v string")}, **options)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nothing_shows_before_the_commit(spark, root):
    store = store_of(spark, root, buckets=4)
    first = store.begin(0)
    first.append("t", spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string"))
    assert rows_of(store.read("t")) == [] and store.last().batch == -1
    first.commit()
    assert rows_of(store.read("t")) == [(1, "a"), (None, "b")] and rows_of(store.read("u")) == []
    assert store.begin(0) is None
    second = store.begin(1)
    second.append("t", spark.createDataFrame([(9, "lost")], "k long, v string"))
    again = store_of(spark, root, buckets=4).begin(1)  # after a crash
    again.append("t", spark.createDataFrame([(2, "c")], "k long, v string"))
    again.commit()
    assert rows_of(store.read("t")) == [(1, "a"), (2, "c"), (None, "b")]


def test_crowded_buckets_are_rewritten_and_records_stay_small(spark, root):
    store = store_of(spark, root, buckets=3, folders=2)
    for n in range(20):
        batch = store.begin(n)
        batch.append("t", spark.createDataFrame([(k, f"{n}-{k}") for k in range(5)], "k long, v string"))
        batch.replace("u", spark.createDataFrame([(n, "only")], "k long, v string"), [0, 1, 2])
        batch.commit()
    assert store.read("t").count() == 100 and rows_of(store.read("u")) == [(19, "only")]
    assert all(len(f) <= 2 for f in store.last().folders["t"].values())
    assert len(os.listdir(f"{root}/commits")) <= 40  # records and their check sums


def test_only_touched_buckets_are_read(spark, root):
    store = store_of(spark, root, buckets=16)
    batch = store.begin(0)
    batch.append("t", spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    batch.commit()
    asked = spark.createDataFrame([(3,), (3,)], "k long")
    buckets = store.touched(asked, "k")
    files = store.begin(1).known("t", asked, "k").inputFiles()
    assert len(buckets) == 1 and files and all(f"bucket={buckets[0]}/" in f for f in files)


# ----------------------------------------------------------------------- ledger
def printed(number: str, tax_id: str, total: int = 500, name: str = "Vidrios Lago S.A.S") -> str:
    return f"Total: {total}.00 USD\nEmisor: {name}\nNIT {tax_id}\nFactura Electrónica de Venta No. {number}\nFecha de Emisión: 03/05/2026\n"


FIRST = [
    (1, 1, printed("AB10", "900111222")), (2, 2, printed("AB11", "900111222", name="Otro Nombre S.A.S")),
    (3, 3, printed("AB10", "900111222")), (4, 4, "nothing to see"), (5, 5, None), (6, 6, "Emisor: Vidrios Lago S.A.S\nNIT 900111222\n"),
]
SECOND = [
    *FIRST[:2], (7, 7, printed("AB11", "900111222")), (8, 8, printed("AB11", "900333444")), (9, 1, printed("AB10", "900111222")),
    (10, 4, "nothing to see"), (11, 11, printed("CD77", "900111222")), (11, 11, printed("CD77", "900111222")),
]
DDL = "job_id long, document_id long, text string"


def run_ledger(spark, root, deliveries, **options):
    store = ledger.open_ledger(spark, os.path.join(root, "ledger"), **options)
    for n, rows in enumerate(deliveries):
        ledger.write_batch(store, spark.createDataFrame(rows, DDL), n, AS_OF)
    return store


def contents(store):
    return {name: rows_of(store.read(name)) for name in ledger.TABLES}


def test_ledger_of_two_deliveries(spark, root):
    store = run_ledger(spark, root, [FIRST, SECOND], buckets=4)
    documents = {r.document_id: (r.status, r.code, r.invoice_id) for r in store.read("documents").collect()}
    assert documents == {
        1: ("PROCESSED", "", 1), 2: ("PROCESSED", "", 2), 3: ("FAILED", "persistence_error", None),
        4: ("FAILED", "llm_extraction_failed", None), 5: ("FAILED", "document_not_found", None),
        6: ("FAILED", "llm_extraction_partial", None), 7: ("FAILED", "persistence_error", None), 8: ("PROCESSED", "", 8),
        11: ("PROCESSED", "", 11)}
    jobs = {r.job_id: (r.status, r.code, r.invoice_id) for r in store.read("jobs").collect()}
    assert jobs[9] == ("COMPLETED", "", 1)  # another job of a stored document ends on its invoice
    assert jobs[10] == ("FAILED", "llm_extraction_failed", None) and set(jobs) == {*range(1, 12)}
    suppliers = {r.tax_id: (r.supplier_id, r.name) for r in store.read("suppliers").collect()}
    assert suppliers == {"900111222": (1, "VIDRIOS LAGO S.A.S"), "900333444": (8, "VIDRIOS LAGO S.A.S")}
    assert {r.invoice_id: (r.supplier_id, r.number) for r in store.read("invoices").collect()} == {
        1: (1, "AB10"), 2: (1, "AB11"), 8: (8, "AB11"), 11: (1, "CD77")}
    assert sorted(r.invoice_id for r in store.read("items").collect()) == [1, 2, 8, 11]


def test_ledger_is_the_same_after_crashes_and_redelivery(spark, root, monkeypatch):
    want = contents(run_ledger(spark, os.path.join(root, "whole"), [FIRST, SECOND], buckets=2))
    write, record = ledger.Batch._write, Store._record
    store = run_ledger(spark, root, [FIRST], buckets=2)
    before = contents(store)
    for crash in (1, 3, 6, 7):
        calls = []

        def failing(self, *args):
            if len(calls) == crash:
                raise OSError("executor lost")
            calls.append(1)
            return write(self, *args)

        monkeypatch.setattr(ledger.Batch, "_write", failing)
        if crash == 7:  # all tables written, the record not
            monkeypatch.setattr(Store, "_record", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            ledger.write_batch(store, spark.createDataFrame(SECOND, DDL), 1, AS_OF)
        assert contents(store) == before
    monkeypatch.setattr(ledger.Batch, "_write", write)
    monkeypatch.setattr(Store, "_record", record)
    for _ in range(2):  # delivered again, and once more after its commit
        ledger.write_batch(store, spark.createDataFrame(SECOND, DDL), 1, AS_OF)
    assert contents(store) == want


def test_later_batches_read_touched_buckets_of_the_ledger_only(spark, root, monkeypatch):
    store = run_ledger(spark, root, [[(k, k, printed(f"ZX{k}00", f"9001{k:05d}")) for k in range(1, 60)]], buckets=16)
    read = []
    real = Store.read

    def watch(self, name, buckets=None, commit=None):
        read.append((name, buckets))
        return real(self, name, buckets, commit)

    monkeypatch.setattr(Store, "read", watch)
    ledger.write_batch(store, spark.createDataFrame([(99, 99, printed("NEW70", "900100007"))], DDL), 1, AS_OF)
    assert {n for n, _ in read} == {"jobs", "documents", "suppliers", "invoices"}
    assert all(b is not None and len(b) == 1 for _, b in read)
    monkeypatch.undo()
    assert store.read("suppliers").filter("tax_id = '900100007'").first().supplier_id == 7


def test_empty_and_odd_deliveries(spark, root):
    store = run_ledger(spark, root, [[], [(1, 1, None), (None, 2, ""), (3, 3, "\x00\x01" * 50)]], buckets=2)
    assert {r.document_id: r.code for r in store.read("documents").collect()} == {
        1: "document_not_found", 2: "llm_extraction_failed", 3: "llm_extraction_failed"}
    assert store.read("invoices").count() == 0


# ----------------------------------------------------------------------- events
def test_events_late_and_in_many_parts_give_the_batch_results(spark, sf_dir, root):
    source, checkpoint = os.path.join(root, "events"), os.path.join(root, "checkpoint")
    events = load(spark, sf_dir, "events")
    store = streams.event_store(spark, os.path.join(root, "out"), buckets=4)
    want = lifecycle.fold_jobs(derived.job_events(events))
    for k in range(4):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(events.schema).parquet(source)
        streams.fold_stream(derived.job_events(arriving), store, checkpoint)
        # Counts are those of the folded jobs after every batch.
        assert rows_of(store.read("counts")) == rows_of(streams.folded_state(store).groupBy("status").count())
    assert rows_of(streams.folded_state(store)) == rows_of(want)


def test_counts_are_moved_by_touched_jobs_and_survive_a_crash(spark, root, monkeypatch):
    ddl = "job_id long, event_id long, ts timestamp, kind string, message string, invoice_id long"
    rng, t0 = random.Random(8), datetime(2024, 1, 1)

    def events(n, jobs):
        return spark.createDataFrame([
            (rng.choice(jobs), 1000 * n + i, t0 + timedelta(hours=rng.randrange(90)), rng.choice(["start", "complete", "fail"]), "m", i)
            for i in range(60)], ddl)

    store = streams.event_store(spark, os.path.join(root, "out"), buckets=32)
    batches = [events(0, range(40)), events(1, [3]), events(2, range(40, 50))]
    streams.fold_batch(store, batches[0], 0)
    read, real = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, buckets=None, commit=None: read.append((name, buckets)) or real(self, name, buckets, commit))
    streams.fold_batch(store, batches[1], 1)
    assert all(len(b) == 1 for n, b in read if n in ("events", "effects")) and {n for n, _ in read} == {"events", "effects", "counts"}
    monkeypatch.undo()
    record = Store._record
    monkeypatch.setattr(Store, "_record", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError):
        streams.fold_batch(store, batches[2], 2)
    monkeypatch.setattr(Store, "_record", record)
    for _ in range(2):
        streams.fold_batch(store, batches[2], 2)
    whole = lifecycle.fold_jobs(batches[0].union(batches[1]).union(batches[2]))
    assert rows_of(store.read("counts")) == rows_of(whole.groupBy("status").count())
    assert json.loads(spark.read.text(f"{store.root}/commits/{2:012d}.json", wholetext=True).first()[0]).keys() == store.tables.keys()


def test_sent_files_share_folders(spark, tmp_path):
    """A folder, and a commit by the driver, for every file made the run too slow for many files."""
    files = spark.range(3000).selectExpr("id AS file_id", "CASE WHEN id % 3 = 0 THEN X'' ELSE encode(concat('é', id, '\n'), 'UTF-8') END AS content")
    manifest = spark.range(3000).selectExpr("id AS file_id", "'a.pdf' AS filename", "'x' AS declared_mime", "current_timestamp() AS received_at")
    for path in (str(tmp_path / "a b"), f"file://{tmp_path}/c"):
        sinks.write_files(files, path)
        got = {r.doc_id: bytes(r.content) for r in sinks.read_sent(spark, path, manifest).collect()}
        assert got == {r.file_id: bytes(r.content) for r in files.collect()}
    assert len(list((tmp_path / "c").iterdir())) <= sinks.SENT_FOLDERS


def test_sent_files_are_not_listed_by_the_driver(spark, tmp_path):
    """A path of every file on the driver, twice, made its memory grow with the files."""
    files = spark.range(3000).selectExpr("id - 5 AS file_id", "CASE WHEN id % 3 > 0 THEN encode(concat('%PDF-', id), 'UTF-8') END AS content")
    manifest = spark.range(3000).selectExpr("id - 5 AS file_id", "concat(id, '.pdf') AS filename", "CAST(NULL AS STRING) AS declared_mime", "timestamp_ntz'2024-01-01 00:00:00' AS received_at")
    path, out, checkpoint = (str(tmp_path / name) for name in ("sent", "out", "checkpoint"))
    want = {r.file_id: bytes(r.content) for r in files.filter("content IS NOT NULL").collect()}
    sinks.write_files(files, path)
    found = sinks.read_sent(spark, path, manifest)
    assert not found.inputFiles()
    assert {r.doc_id: bytes(r.content) for r in found.filter("octet_length(content) > 0").collect()} == want
    assert found.count() == 3000
    for new in (-9, None):  # what arrives later is seen, and nothing twice
        streams.ingest_stream(sinks.sent_stream(spark, path, manifest, notices_per_batch=3), out, checkpoint)
        documents = streams.ingested(spark, out)[0].collect()
        assert sorted((r.document_id, r.size_bytes) for r in documents) == sorted((k, len(c)) for k, c in want.items())
        if new:
            manifest = manifest.union(manifest.limit(1).withColumn("file_id", F.lit(new).cast("long")))
            sinks.write_files(spark.sql(f"SELECT CAST({new} AS LONG) AS file_id, encode('%PDF-later', 'UTF-8') AS content"), path)
            want[new] = b"%PDF-later"
    logs = [p for p in (tmp_path / "checkpoint" / "sources").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert 0 < sum(len(p.read_text().splitlines()) - 1 for p in logs) <= 2 * spark.sparkContext.defaultParallelism
