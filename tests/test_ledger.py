"""Numbering, lifecycles, persistence, ingest and streams."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle, persist, reports, validate
from ledgerloom.operators.ingest import assemble_pages, audit_files
from ledgerloom.operators.numbering import dense_position
from ledgerloom.sources import derived, sinks
from ledgerloom.sources.tables import load
from ledgerloom.streaming import jobs as streams


def test_dense_position_with_copies_and_a_hot_key(spark):
    random.seed(3)
    data = [("hot" if random.random() < 0.5 else f"k{random.randrange(9)}", random.randrange(12), random.randrange(3))
            for _ in range(800)]
    df = spark.createDataFrame(data, "k string, a int, b int")
    out = dense_position(df, "k", F.col("a") % 4, ["a", "b"]).collect()
    seen = defaultdict(list)
    for r in out:
        seen[r.k].append((r.position, (r.a % 4, r.a, r.b)))
    for key, got in seen.items():
        want = sorted((a % 4, a, b) for k, a, b in data if k == key)
        assert [p for p, _ in sorted(got)] == list(range(len(want)))
        assert [v for _, v in sorted(got)] == want


def _by_hand(machine, events):
    state, starts, illegal, first, last, message, invoice = 0, 0, 0, None, None, None, None
    for ts, _, kind, text, number in sorted(events):
        if kind not in machine.moves:
            continue
        after = machine.moves[kind].get(state)
        if after is None:
            illegal += 1
            continue
        state = after
        if kind == "start":
            starts, first = starts + 1, first or ts
        else:
            last = ts
        if kind == "fail":
            message = text
        if kind == "complete" and number is not None:
            invoice = number
    return machine.states[state], starts, illegal, first, last, message, invoice


@pytest.mark.parametrize("machine", [lifecycle.JOB, lifecycle.DOCUMENT])
def test_fold_matches_a_plain_loop(spark, machine):
    random.seed(11)
    logs, t0 = defaultdict(list), datetime(2024, 1, 1)
    for i in range(1500):
        job = 1 if random.random() < 0.6 else random.randrange(2, 8)
        kind = random.choice(["start", "start", "complete", "fail", "upload"])
        logs[job].append((t0 + timedelta(minutes=random.randrange(600)), i, kind, f"m{i}" * 900,
                          i if random.random() < 0.5 else None))
    data = [(j, e[1], e[0], e[2], e[3], e[4]) for j, es in logs.items() for e in es]
    df = spark.createDataFrame(
        data, "job_id long, event_id long, ts timestamp, kind string, message string, invoice_id long")
    for sizes in ({"piece": 7}, {"ranges": 1}, {"ranges": 40, "piece": 5, "fan_in": 3}):
        folded = lifecycle.current_state(lifecycle.fold_events(df, machine, **sizes), machine)
        assert sorted(map(tuple, folded.collect())) == sorted((j, *_by_hand(machine, es)) for j, es in logs.items())


def test_a_hot_instant_of_a_hot_job_is_spread(spark):
    """A third of all events are one job's at one instant: its events fill a third of the ranges, none is crowded."""
    events = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("job_id"), F.col("id").alias("event_id"),
        F.lit(datetime(2024, 1, 1)).alias("ts"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("long").alias("invoice_id"))
    placed = lifecycle.in_ranges(events, "job_id", 12).groupBy("_range").agg(F.count("*").alias("n"), F.count_if(F.col("job_id") == 0).alias("hot"))
    sizes = placed.collect()
    assert len(sizes) == 12 and max(r.n for r in sizes) < 2_000 and sum(r.hot > 0 for r in sizes) >= 3
    state = lifecycle.current_state(lifecycle.fold_events(events, lifecycle.JOB, ranges=12), lifecycle.JOB)
    assert state.filter("job_id = 0").first().attempts == 4_000 and state.count() == 8_001


def test_fold_shuffles_events_twice_and_effects_up_the_tree(spark, sf_dir):
    folded = lifecycle.fold_events(derived.job_events(load(spark, sf_dir, "events")), lifecycle.JOB, ranges=100)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(shuffled) == 4 and sum("rangepartitioning" in line for line in shuffled) == 1
    assert sum("hashpartitioning(_range" in line for line in shuffled) == 1


def test_dedup_keeps_first_processed_and_skips_known(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([
        (1, t + timedelta(1), "late", "900 ", "a"), (2, t, "first", " 900", "b"), (3, t, "tie", "900", "c"),
        (4, t, "known", "901", "d"), (5, t, "dotted", "9.00", "e"),
    ], "doc_id int, processed_at timestamp, name string, tax_id string, address string")
    known = spark.createDataFrame([("901",)], "tax_id string")
    got = {r.tax_id: r.name for r in persist.dedup_suppliers(df, known).collect()}
    assert got == {"900": "first", "9.00": "dotted"}


def test_warning_band_needs_many_items(spark):
    head = spark.createDataFrame(
        [(1, Decimal("100.00"), 700, Decimal("106.00")), (2, Decimal("100.00"), 3, Decimal("106.00")),
         (3, Decimal("1.00"), None, None)],
        "invoice_id int, subtotal decimal(14,2), n_items long, items_total decimal(18,2)")
    got = {r.invoice_id: (r.code, r.severity) for r in validate.header_check(head, validate.item_sum_issues()).collect()}
    assert got == {1: ("math.items_subtotal_mismatch", "WARNING"), 2: ("math.items_subtotal_mismatch", "ERROR"),
                   3: ("items.empty", "ERROR")}


def test_report_has_one_shape_at_any_size(spark):
    invoices = spark.createDataFrame([(1,), (2,)], "invoice_id long")
    issues = spark.range(2500).select(
        F.lit(1).cast("long").alias("invoice_id"), F.lit(11).alias("rule_ord"), F.col("id").cast("int").alias("item"),
        F.lit("c").alias("code"), F.lit("ERROR").alias("severity"), F.lit("m").alias("message"), F.lit("f").alias("field"))
    got = [(r.invoice_id, r.is_valid, r.item) for r in validate.validation_report(invoices, issues).collect()]
    assert sorted(got, key=str) == sorted([(1, False, k) for k in range(2500)] + [(2, True, None)], key=str)


def test_one_poisoned_value_rejects_one_document(spark, rows):
    from decimal import Decimal

    from ledgerloom.functions.amounts import contract_amount, latam_amount, ledger_money
    from ledgerloom.operators.extract import extract

    big = "1234567890123456789012"
    for reading in (latam_amount, contract_amount, ledger_money):
        got = rows([(big,), ("1e99",), ("12",)], "raw string", lambda df: df.select(reading(F.col("raw")).alias("v")))
        assert [r["v"] for r in got] == [None, None, Decimal("12")]
    docs = spark.createDataFrame([(1, f"TOTAL A PAGAR: {big}"), (2, "TOTAL A PAGAR: 500")], "doc_id int, text string")
    assert {r.doc_id: r.total for r in extract(docs).collect()} == {1: None, 2: Decimal("500.00")}
    line = spark.createDataFrame([(1, Decimal("999999999.999"), Decimal("999999999999.99"), Decimal("1.00"))],
                                 "invoice_id int, quantity decimal(12,3), unit_price decimal(14,2), total decimal(14,2)")
    assert validate.line_totals(line).first().net_total > 10**20
    payload = "doc_id int, number string, money struct<subtotal:decimal(30,10),tax:decimal(30,10),total:decimal(30,10)>, " \
              "items array<struct<quantity:decimal(30,10),unit_price:decimal(30,10),tax:decimal(30,10),total:decimal(30,10)>>"
    money = (Decimal(1), Decimal(0), Decimal(1))
    table = spark.createDataFrame([
        (1, "a", (Decimal(1), Decimal(0), Decimal(5 * 10**12)), [money + (Decimal(1),)]), (2, "b", money, [money + (Decimal(1),)]),
        (3, "c", money, [(Decimal(1), Decimal(10**13), Decimal(0), Decimal(1))])], payload)
    assert sorted(r.doc_id for r in persist.unstorable(table).collect()) == [1, 3]


def test_duplicates_of_stored_invoices_and_jobs_once(spark):
    new = spark.createDataFrame([(1, 7, "A", 1), (2, 7, "A", 2), (3, 8, "A", 3)],
                                "invoice_id int, supplier_id int, number string, created_at int")
    stored = spark.createDataFrame([(8, "A"), (8, "A")], "supplier_id int, number string")
    assert {r.invoice_id: r.outcome for r in persist.reject_duplicates(new, stored).collect()} == {
        1: "kept", 2: "rejected", 3: "rejected"}
    jobs = spark.createDataFrame([(1, 1, "PENDING"), (2, 2, "PENDING"), (3, 3, "COMPLETED")],
                                 "job_id int, document_id int, status string")
    invoices = spark.createDataFrame([(10, 1, 1), (11, 1, 2)], "invoice_id int, document_id int, created_at int")
    documents = spark.createDataFrame([(1,), (1,), (3,)], "document_id int")
    got = {r.job_id: (r.stored_invoice_id, r.action) for r in persist.next_action(jobs, invoices, documents).collect()}
    assert got == {1: (11, "resume"), 2: (None, "document_not_found"), 3: (None, "skip")}


def test_page_rejects_bad_bounds(spark):
    df = spark.range(1)
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            reports.page(df, **bad)
    with pytest.raises(ValueError):
        reports.listing(df, df, date_from="2024-02-01", date_to="2024-01-01")


def test_search_wildcards_and_backslashes():
    assert reports._pattern(" a_b% ") == "%a_b%%"
    assert reports._pattern(r"50\% c\d") == r"%50\% cd%"


def test_pages_of_one_document_are_one_row(spark):
    long = "x" * 40
    df = spark.createDataFrame(
        [(1, 0, long, None), (1, 1, " thin ", " scan "), (1, 2, "t", " "), (2, 0, long, "o"), (1, 1500, "", "last")],
        "doc_id int, page_no int, embedded_text string, ocr_text string")
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    got = {r.doc_id: (r.text, r.page_count, r.method) for r in assemble_pages(df, documents=documents).collect()}
    assert got == {1: (f"{long}\n\nscan\n\nt\n\nlast", 4, "embedded-text+tesseract (ocr_pages=3)"),
                   2: (long, 1, "embedded-text"), 3: ("", 0, "empty")}


def test_binary_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.pdf").write_bytes(b"junk%PDF-1.7")
    (tmp_path / "two.png").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "three.jpg").write_bytes(b"")
    (tmp_path / "four.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 50)
    (tmp_path / "one.pdf").write_bytes(b"%PDF-1.7 other")
    manifest = spark.createDataFrame(
        [(f"file:{tmp_path}/three.jpg", None), (f"file:{tmp_path}/a/one.pdf", None)], "path string, declared_mime string")
    ids = [r.doc_id for r in sinks.read_files(spark, str(tmp_path), manifest).collect()]
    assert len(ids) == len(set(ids)) == 5  # files of one name in two folders are two files
    got = {r.filename: (r.error_code, r.reason, r.mime_type)
           for r in audit_files(sinks.read_files(spark, str(tmp_path), manifest), 40).collect()}
    assert got == {
        "one.pdf": (None, None, "application/pdf"), "two.png": (None, None, "image/jpeg"),
        "three.jpg": ("empty_file", "empty", None), "four.png": ("file_too_large", "too_large", None)}


def test_file_stream_registers_new_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n in range(3):
        (source / f"f{n}.pdf").write_bytes(b"%PDF-1.7 " + bytes(n))
        (source / f"bad{n}.pdf").write_bytes(b"text")
        streams.ingest_stream(sinks.file_stream(spark, str(source)), out, checkpoint)
    documents, jobs = streams.ingested(spark, out)
    assert sorted(r.filename for r in documents.collect()) == ["f0.pdf", "f1.pdf", "f2.pdf"]
    assert {(r.status, r.attempts) for r in jobs.collect()} == {("PENDING", 0)}


def test_dated_sink_prunes_and_a_rerun_adds_nothing(spark, tmp_path, sf_dir):
    out = str(tmp_path / "ledger")
    jobs = derived.jobs(spark, sf_dir)
    for batch in ("a", "b", "a"):
        sinks.write_dated(jobs.filter(f"job_id % 2 = {int(batch == 'a')}"), out, batch=batch)
    back = sinks.read_dated(spark, out)
    assert back.count() == jobs.count()
    month = back.filter("year = 1997 AND month = 2")
    assert month.count() == jobs.filter("year(created_at) = 1997 AND month(created_at) = 2").count()
    assert "PartitionFilters: [isnotnull(year" in month._jdf.queryExecution().executedPlan().toString()


def test_stored_invoices_are_not_shuffled(spark, tmp_path):
    """The ledger lies dealt by (supplier, number): only the new invoices move to it."""
    rows = spark.range(4000).select(
        F.col("id").alias("invoice_id"), (F.col("id") % 40).alias("supplier_id"), (F.col("id") % 90).cast("string").alias("number"),
        F.col("id").alias("created_at"))
    stored = sinks.write_bucketed(rows.select("supplier_id", "number"), "stored_invoices", str(tmp_path / "t"), ("supplier_id", "number"), 8)
    new = rows.withColumn("invoice_id", F.col("invoice_id") + 9000).withColumn("number", F.concat("number", F.when(F.col("invoice_id") % 3 == 0, "x").otherwise("")))
    out = persist.reject_duplicates(new, stored.hint("merge"))
    left = new.join(stored.hint("merge").select("supplier_id", "number").distinct(), ["supplier_id", "number"], "left_anti")
    plan = left._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("SortMergeJoin"):].split("Exchange hashpartitioning")
    assert len(stored_side) == 2 and "Bucketed: true" in stored_side[1]
    assert out.filter("outcome = 'kept'").count() == left.select("supplier_id", "number").distinct().count()
    spark.sql("DROP TABLE stored_invoices")


def _pages(spark, n):
    return spark.range(n).select(
        F.col("id").alias("invoice_id"), F.expr("date_add(DATE'2024-01-01', CAST(id % 7 AS INT))").alias("issue_date"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id % 5 AS INT))").alias("created_at"))


def test_deep_pages_read_one_range(spark, tmp_path):
    rows, at = _pages(spark, 5000), str(tmp_path / "pages")
    reports.write_page_index(rows, at, 25)
    index = spark.read.parquet(at)
    ordered = [tuple(r) for r in rows.orderBy(*reports._newest()).collect()]
    for offset in (0, 190, 2500, 4990, 5000, 9999):
        deep = reports.page_at(index, 20, offset)
        assert [tuple(r)[:3] for r in deep.collect()] == ordered[offset:offset + 20]
        if offset < 5000:
            assert deep.first().total_count == 5000
            assert len({f.split("page_range=")[1].split("/")[0] for f in deep.inputFiles()}) >= 1
    plan = reports.page_at(index, 20, 2500)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*page_range", plan)
    read = index.filter(F.col("page_range").isin([12])).count()
    assert read < 5000 / 10


def test_pages_after_a_row(spark):
    rows = _pages(spark, 300)
    ordered = [tuple(r) for r in rows.orderBy(*reports._newest()).collect()]
    last, seen = None, []
    while True:
        part = reports.page(rows, 100).drop("total_count") if last is None else reports.page_after(rows, last, 100)
        got = [tuple(r) for r in part.collect()]
        if not got:
            break
        seen += got
        last = (got[-1][1], got[-1][2], got[-1][0])
    assert seen == ordered


@pytest.mark.parametrize("search", ["fe10", " SUR 7", "a%s.a", "e_1", "x", "", "900_0", r"10\%", "Ñandú", "no such text", "%", r"a\_b"])
def test_search_by_index_gives_the_rows_of_the_scan(spark, tmp_path_factory, search, search_tables):
    invoices, suppliers, index = search_tables
    got = reports.listing_by_index(invoices, suppliers, index, search, 16)
    want = reports.listing(invoices, suppliers, search)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.fixture(scope="module")
def search_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("grams") / "t")
    invoices = spark.range(600).select(
        F.col("id").alias("invoice_id"), F.col("id").alias("document_id"),
        F.when(F.col("id") % 50 == 3, F.lit("10%")).when(F.col("id") % 50 == 4, F.lit("a_b c")).otherwise(F.concat(F.lit("FE"), F.col("id").cast("string"))).alias("number"),
        (F.col("id") % 40).alias("supplier_id"), F.lit(None).cast("date").alias("issue_date"), F.lit(None).cast("date").alias("due_date"),
        F.lit("EUR").alias("currency"), *[F.lit(1).cast("decimal(14,2)").alias(c) for c in ("subtotal", "tax_amount", "total")],
        F.lit(datetime(2024, 1, 1)).alias("created_at"))
    suppliers = spark.range(38).select(
        F.col("id").alias("supplier_id"), F.when(F.col("id") == 5, F.lit("ÑANDÚ S.A")).otherwise(F.concat(F.lit("Casa Sur "), F.col("id").cast("string"), F.lit(" S.A.S"))).alias("name"),
        (F.lit(900000) + F.col("id")).cast("string").alias("tax_id"))
    reports.write_search_index(invoices, suppliers, at, 16)
    return invoices, suppliers, spark.read.parquet(at)


def test_search_reads_the_folders_of_its_runs_only(spark, search_tables):
    assert reports.search_grams(" e1_3 ") == [] and reports.search_grams("Sur 7") == ["r 7", "sur", "ur "]
    assert reports.search_grams(r"ab\%cde") == ["cde"] and reports.search_grams("abcd") == ["abc", "bcd"]
    plan = reports.listing_by_index(*search_tables, "sur", 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
