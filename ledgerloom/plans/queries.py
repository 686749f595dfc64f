"""One registered query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates
from ledgerloom.functions.text import markup_lines, safe_filename, text_lines, with_normalized
from ledgerloom.operators import (
    contract,
    extract,
    fusion,
    ingest,
    lifecycle,
    persist,
    replies,
    reports,
    rules,
    validate,
)
from ledgerloom.plans.portable import portable
from ledgerloom.session import fresh_dir, stored
from ledgerloom.sources import derived, sinks
from ledgerloom.sources.tables import load
from ledgerloom.streaming import jobs as streams
from ledgerloom.streaming import ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "1998-06-01"
MAX_BYTES = 6000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_")] = lambda spark, sf_dir: portable(fn(spark, sf_dir))
    return fn


# ------------------------------------------------------------ sources and ingest
def _audited(spark, sf, max_bytes=ingest.MAX_BYTES):
    return ingest.audit_files(derived.file_table(spark, sf), max_bytes)


@query
def ingest_file_audit(spark, sf):
    return _audited(spark, sf, MAX_BYTES).select(
        "doc_id", "size_bytes", *[F.coalesce(c, F.lit("")).alias(c) for c in (
            "reason", "error_code", "document_type", "mime_type")]
    )


@query
def ingest_sent_files(spark, sf):
    """Real files, written from the documents, audited from their folder and registered once more as a stream."""
    out, checkpoint = streams.scratch(spark, "sent")
    sent = f"{out}-files"
    rows = derived.file_table(spark, sf).withColumnRenamed("doc_id", "file_id")
    ended = F.when(F.octet_length("content") > 0, F.concat("content", F.lit(b"\n"))).otherwise(F.col("content"))
    sinks.write_files(rows.withColumn("content", ended), sent)
    manifest = rows.drop("content")
    audited = ingest.audit_files(sinks.read_sent(spark, sent, manifest), MAX_BYTES)
    streams.ingest_stream(sinks.sent_stream(spark, sent, manifest), out, checkpoint, MAX_BYTES)
    documents, _ = streams.ingested(spark, out)
    streamed = documents.select(F.col("document_id").alias("doc_id"), F.col("status").alias("streamed"))
    rows = audited.join(streamed, "doc_id", "left")
    return rows.select("doc_id", "size_bytes", *[F.coalesce(c, F.lit("")).alias(c) for c in (
        "reason", "error_code", "document_type", "mime_type", "streamed")])


@query
def ingest_magic_sniff(spark, sf):
    return ingest.sniff(derived.file_table(spark, sf)).na.fill("")


@query
def ingest_safe_filename(spark, sf):
    return derived.file_table(spark, sf).select("doc_id", safe_filename(F.col("filename")).alias("filename"))


@query
def ingest_storage_layout(spark, sf):
    """Files' storage keys in a dated tree, written twice and read back by its folders."""
    f = derived.file_table(spark, sf)
    rows = f.select("doc_id", "received_at", ingest.storage_key(
        F.col("doc_id"), F.col("filename"), F.col("received_at")).alias("storage_path"))
    at = fresh_dir(spark, "dated")
    for _ in range(2):  # a rerun replaces its own folders
        sinks.write_dated(rows, at, "received_at")
    return sinks.read_dated(spark, at).select("doc_id", "storage_path", "year", "month")


@query
def ingest_register(spark, sf):
    """Documents and their jobs side by side; both are projections of one audit."""
    documents = ingest.register_documents(_audited(spark, sf))
    return documents.withColumns({"job_status": F.lit("PENDING"), "attempts": F.lit(0)})


@query
def page_text_assembly(spark, sf):
    done = ingest.assemble_pages(derived.doc_pages(spark, sf), documents=load(spark, sf, "documents"))
    return done.select("doc_id", F.md5("text").alias("text_md5"), "page_count", "method")


@query
def markup_to_lines(spark, sf):
    return markup_lines(load(spark, sf, "pages"), "page_id", "html")


@query
def lookup_by_key(spark, sf):
    """Supplier of each order's customer number, and the newest invoice of its document."""
    keys = load(spark, sf, "orders").select(
        F.concat(F.lit(" "), (F.lit(900000000) + F.col("o_custkey")).cast("string")).alias("tax_id"),
        F.col("o_orderkey").alias("document_id"),
    )
    suppliers = reports.supplier_by_tax_id(keys, derived.suppliers(spark, sf)).select(
        F.lit("supplier").alias("kind"), F.col("supplier_id").alias("id"), F.col("tax_id").alias("found"))
    newest = reports.latest_by_document(derived.invoices(spark, sf))
    invoices = reports.lookup(keys, newest, "document_id").select(
        F.lit("invoice").alias("kind"), F.col("document_id").alias("id"),
        F.col("invoice_id").cast("string").alias("found"))
    return suppliers.unionByName(invoices)


# ------------------------------------------------------------------- extraction
def _docs(spark, sf):
    return derived.invoice_texts(spark, sf)


def _canonical(spark, sf):
    return extract.canonical(_docs(spark, sf))


def _filled(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names})


@query
def text_normalize(spark, sf):
    return with_normalized(load(spark, sf, "documents")).select(
        "doc_id", F.length("norm").alias("n_chars"), F.md5("norm").alias("norm_md5"))


@query
def text_lines_(spark, sf):
    return text_lines(load(spark, sf, "documents")).select("doc_id", "line_no", F.md5("line").alias("line_md5"))


@query
def extract_number(spark, sf):
    rows = extract.add_number(_canonical(spark, sf), rules.DEFAULT_RULES)
    return _filled(rows, "number", "number_pattern").select("doc_id", "number", "number_pattern")


@query
def exclude_authorization(spark, sf):
    """Every numbered match of the e-invoice rule and whether wording before it rules it out."""
    rule = rules.rules_for(rules.DEFAULT_RULES, "number")[1]
    rows = _canonical(spark, sf).withColumn(
        "found", extract.matches_in_context(F.col("norm"), rule))
    return rows.select("doc_id", F.posexplode("found").alias("match_no", "m")).select(
        "doc_id", "match_no", F.col("m.value").alias("value"), F.col("m.excluded").alias("excluded"))


@query
def extract_supplier(spark, sf):
    rows = extract.with_supplier(_canonical(spark, sf))
    return _filled(rows.select("doc_id", F.col("supplier.name").alias("name"), "supplier_pattern"),
                   "name", "supplier_pattern")


@query
def extract_tax_id(spark, sf):
    rows = extract.with_supplier(_canonical(spark, sf))
    return _filled(rows.select("doc_id", F.col("supplier.tax_id").alias("tax_id"), "tax_id_pattern"),
                   "tax_id", "tax_id_pattern")


@query
def extract_labelled_date(spark, sf):
    rows = extract.add_dates(_canonical(spark, sf), rules.DEFAULT_RULES)
    names = ("issue_date", "issue_date_pattern", "due_date", "due_date_pattern")
    return _filled(rows, *names).select("doc_id", *names)


@query
def extract_any_date(spark, sf):
    rows = _canonical(spark, sf).select("doc_id", extract.any_date_hit(F.col("norm")).alias("d"))
    return _filled(rows.select("doc_id", F.col("d.value").alias("any_date")), "any_date")


@query
def parse_date(spark, sf):
    """Every order date printed in one of six shapes, good and bad."""
    shape, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    months = "array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Set','Oct','Nov','Dic')"
    printed = (
        F.when(shape == 0, F.date_format(d, "d/M/yyyy"))
        .when(shape == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00")))
        .when(shape == 2, F.concat(F.date_format(d, "dd"), F.lit("-"),
                                   F.expr(f"element_at({months}, month(o_orderdate))"),
                                   F.date_format(d, "-yyyy")))
        .when(shape == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" / 30/02/2020")))
        .when(shape == 4, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" y 01/02/2020")))
        .otherwise(F.concat(F.lit("31-Xyz-"), F.date_format(d, "yyyy")))
    )
    rows = load(spark, sf, "orders").select("o_orderkey", F.upper(printed).alias("raw"))
    return _filled(rows.select("o_orderkey", "raw", dates.parse_date(F.col("raw")).alias("day")), "day")


@query
def extract_amounts(spark, sf):
    rows = extract.add_amounts(_canonical(spark, sf), rules.DEFAULT_RULES)
    names = ("total", "total_pattern", "tax", "tax_pattern", "printed_subtotal")
    return _filled(rows, *names).select("doc_id", *names)


def _amounts(spark, sf, reading):
    rows = derived.amount_strings(spark, sf)
    value = F.coalesce(reading(F.col("raw")).cast("string"), F.lit("rejected"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", value.alias("amount"))


@query
def parse_latam_amount(spark, sf):
    return _amounts(spark, sf, amounts.latam_amount)


@query
def extract_currency(spark, sf):
    """Currency of the printed invoices and of the general documents."""
    printed = _canonical(spark, sf).select(F.lit("invoice").alias("kind"), "doc_id", "norm")
    general = extract.canonical(load(spark, sf, "documents").select("doc_id", "text")).select(
        F.lit("document").alias("kind"), "doc_id", "norm")
    return printed.unionByName(general).select(
        "kind", "doc_id", extract.currency_of(F.col("norm")).alias("c")
    ).select("kind", "doc_id", F.col("c.code").alias("code"), F.col("c.confident").alias("confident"))


@query
def extract_item_rows(spark, sf):
    found = extract.items_hit(F.col("norm"), rules.in_plan(rules.DEFAULT_RULES))["value"]
    rows = _canonical(spark, sf).select("doc_id", found.alias("rows"))
    return rows.select("doc_id", F.posexplode("rows").alias("position", "i")).select("doc_id", "position", "i.*")


@query
def synthesize_item(spark, sf):
    rows = extract.extract(_docs(spark, sf)).filter((F.size("item_rows") == 0) & (F.size("items") > 0))
    return rows.select("doc_id", F.inline("items"))


@query
def reconcile_subtotal(spark, sf):
    rows = extract.add_amounts(_canonical(spark, sf), rules.DEFAULT_RULES)
    return _filled(rows, "subtotal", "subtotal_pattern").select(
        "doc_id", "subtotal", "subtotal_pattern", "subtotal_derived")


def _report(spark, sf):
    return extract.extraction_report(extract.extract(_docs(spark, sf)))


@query
def extraction_report(spark, sf):
    return _report(spark, sf)


@query
def route_extraction(spark, sf):
    return extract.extract(_docs(spark, sf)).select("doc_id", "route", "missing_fields", "message")


@query
def pattern_hit_rates(spark, sf):
    return extract.pattern_hit_rates(_report(spark, sf))


@query
def rule_table(spark, sf):
    """A stored table of rules, read when the job runs and counted over every printed invoice."""
    at = fresh_dir(spark, "rules")
    rules.rule_table(spark).write.parquet(at)
    return rules.rule_hits(_canonical(spark, sf), spark.read.parquet(at))


# ------------------------------------------------------------ fusion and contract
def _recovered(spark, sf):
    return replies.recover_json(derived.reply_texts(spark, sf))


def _contract(spark, sf):
    return contract.check_contract(contract.fill_items(replies.payloads(_recovered(spark, sf))))


@query
def recover_llm_json(spark, sf):
    number = F.get_json_object("json", "$.number")
    return _recovered(spark, sf).select(
        "doc_id", "outcome", F.coalesce(F.trim(number), F.lit("")).alias("number"))


@query
def contract_check(spark, sf):
    c = _contract(spark, sf)
    return _filled(c, "number", "issue_date", "currency").select(
        "doc_id", "number", "issue_date", "currency", F.size("items").alias("n_items"),
        "violations", "is_valid")


@query
def coerce_contract_amount(spark, sf):
    return _amounts(spark, sf, lambda raw: amounts.contract_amount(raw).cast("decimal(20,4)"))


def _fused(spark, sf):
    return fusion.fuse_fallback(
        fusion.rules_payload(extract.extract(_docs(spark, sf))), _contract(spark, sf))


def _payload_columns(df: DataFrame) -> DataFrame:
    rows = df.select(
        "*", F.col("money.total").cast("decimal(20,2)").alias("total"),
        F.col("supplier.name").alias("supplier_name"), F.size("items").alias("n_items"))
    return _filled(rows, "number", "issue_date", "due_date", "currency", "total", "supplier_name").withColumn(
        "n_items", F.greatest("n_items", F.lit(0)))


_PAYLOAD = ("doc_id", "outcome", "number", "issue_date", "due_date", "currency", "total",
            "supplier_name", "n_items")


@query
def fuse_rules_fallback(spark, sf):
    return _payload_columns(_fused(spark, sf)).select(*_PAYLOAD, "money_from", "items_from")


@query
def fuse_two_sources(spark, sf):
    rows = fusion.fuse_sources(derived.two_source_texts(spark, sf))
    return _payload_columns(rows).select(*_PAYLOAD, "missing_fields")


# -------------------------------------------------------------------- validation
@query
def money_normalize(spark, sf):
    return _amounts(spark, sf, amounts.ledger_money)


@query
def entity_invariants(spark, sf):
    """Invoices, suppliers and documents an entity would refuse.

    Blank every 23rd number, break every 29th currency, zero every 31st total.
    """
    k = F.col("invoice_id")
    bad = derived.invoices(spark, sf).withColumns({
        "number": F.when(k % 23 == 0, F.lit("  ")).otherwise(F.col("number")),
        "currency": F.when(k % 29 == 0, F.lower("currency")).otherwise(F.col("currency")),
        "total": F.when(k % 31 == 0, F.lit(0).cast("decimal(14,2)")).otherwise(F.col("total")),
    })
    suppliers = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit(" ")).otherwise(F.lit("900123456")).alias("tax_id"),
    )
    documents = load(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        (F.col("n_chars") - 100).alias("size_bytes"), F.col("source").alias("filename"))

    def named(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "faults")

    return (
        named(validate.entity_faults(bad, derived.items(spark, sf)), "invoice", "invoice_id")
        .unionByName(named(validate.supplier_faults(suppliers), "supplier", "supplier_id"))
        .unionByName(named(validate.document_faults(documents), "document", "document_id"))
    )


@query
def invoice_line_totals(spark, sf):
    return validate.line_totals(derived.items(spark, sf))


def _checked(spark, sf, issues):
    return validate.header_check(derived.invoices(spark, sf), issues)


@query
def validate_dates(spark, sf):
    return _checked(spark, sf, validate.date_issues(AS_OF))


@query
def validate_ranges(spark, sf):
    """Ranges over invoices with some amounts pushed out of range, and item quantities."""
    k = F.col("invoice_id")
    zero = F.lit(0).cast("decimal(14,2)")
    pushed = derived.invoices(spark, sf).withColumns({
        "number": F.when(k % 23 == 0, F.lit("  ")).otherwise(F.col("number")),
        "subtotal": F.when(k % 29 == 0, -F.col("subtotal")).otherwise(F.col("subtotal")).cast("decimal(14,2)"),
        "tax_amount": F.when(k % 31 == 0, F.col("tax_amount") - 1).otherwise(F.col("tax_amount")).cast("decimal(14,2)"),
        "total": F.when(k % 37 == 0, zero).otherwise(F.col("total")),
    })
    header = validate.header_check(pushed, validate.required_issues() + validate.range_issues())
    return header.unionByName(validate.item_check(derived.items(spark, sf), validate.quantity_issues()))


@query
def validate_total(spark, sf):
    return _checked(spark, sf, validate.total_issues())


@query
def validate_items_sum(spark, sf):
    invoices = validate.with_item_sums(derived.invoices(spark, sf), derived.items(spark, sf))
    return validate.header_check(invoices, validate.item_sum_issues())


@query
def validate_lines(spark, sf):
    return validate.item_check(derived.items(spark, sf), validate.line_issues())


def _issues(spark, sf):
    return validate.all_issues(derived.invoices(spark, sf), derived.items(spark, sf), AS_OF)


@query
def validation_report(spark, sf):
    report = validate.validation_report(derived.invoices(spark, sf), _issues(spark, sf))
    return _filled(report, "rule_ord", "item", "code", "severity", "message", "field")


@query
def issue_summary(spark, sf):
    return validate.issue_summary(_issues(spark, sf))


# ------------------------------------------------------------------- persistence
@query
def supplier_dedup(spark, sf):
    known = load(spark, sf, "supplier").filter("s_suppkey % 40 = 3").select(
        (F.lit(900000000) + F.col("s_suppkey") % 40).cast("string").alias("tax_id"))
    return persist.dedup_suppliers(derived.supplier_sightings(spark, sf), known)


@query
def duplicate_invoice_reject(spark, sf):
    """Invoices of every fourth document are stored first, dealt by (supplier, number); the others meet them there."""
    invoices = derived.invoices(spark, sf)
    first = F.col("document_id") % 4 == 0
    early = persist.reject_duplicates(invoices.filter(first))
    at = fresh_dir(spark, "ledger")
    kept = early.filter("outcome = 'kept'").select("supplier_id", "number", "invoice_id")
    ledger_rows = sinks.write_bucketed(kept, f"ledger_{at.rsplit('-', 1)[-1]}", at, ("supplier_id", "number"), 8)
    return early.unionByName(persist.reject_duplicates(invoices.filter(~first), ledger_rows.hint("merge")))


@query
def process_once(spark, sf):
    """Every job against stored invoices (those of even documents are stored already) and the documents with lines."""
    stored = derived.invoices(spark, sf).filter("document_id % 2 = 0")
    documents = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    actions = persist.next_action(derived.jobs(spark, sf), stored, documents)
    return _filled(actions, "stored_invoice_id")


def _payloads(spark, sf):
    return _contract(spark, sf).filter("is_valid").drop("violations", "is_valid")


@query
def build_invoice_tables(spark, sf):
    # Stored once: the replies are read and checked once for both tables.
    payloads = stored(_payloads(spark, sf), "payloads")
    head = persist.invoice_rows(payloads, derived.suppliers(spark, sf))
    lines = persist.item_rows(payloads)
    text = [
        F.lit("invoice").alias("kind"), "document_id", F.lit(0).alias("position"),
        F.concat_ws("|", F.coalesce(F.col("supplier_id").cast("string"), F.lit("-")), "number",
                    F.col("issue_date").cast("string"), "currency").alias("what"),
        "subtotal", "tax_amount", "total",
    ]
    items = [
        F.lit("item").alias("kind"), "document_id", "position",
        F.concat_ws("|", "description", F.col("quantity").cast("string")).alias("what"),
        F.col("unit_price").alias("subtotal"), "tax_amount", "total",
    ]
    return head.select(*text).unionByName(lines.select(*items))


@query
def audit_payload(spark, sf):
    rows = persist.audit_payload(_payloads(spark, sf))

    def value(path: str):
        return F.coalesce(F.get_json_object("raw_extraction", path), F.lit("null"))

    return rows.select(
        "doc_id", value("$.number").alias("number"), value("$.issue_date").alias("issue_date"),
        value("$.due_date").alias("due_date"), value("$.total").alias("total"),
        value("$.supplier.tax_id").alias("tax_id"), value("$.items[0].total").alias("first_item_total"))


# ----------------------------------------------------------- queries, aggregates
def _listing(spark, sf, **criteria):
    return reports.listing(derived.invoices(spark, sf), derived.suppliers(spark, sf), **criteria)


@query
def invoice_search(spark, sf):
    """Contains-search with a wildcard, over what an index of three-character runs leaves."""
    invoices, suppliers = derived.invoices(spark, sf), derived.suppliers(spark, sf)
    at = fresh_dir(spark, "grams")
    reports.write_search_index(invoices, suppliers, at, 16)
    rows = reports.listing_by_index(invoices, suppliers, spark.read.parquet(at), " ndina _ s.a", 16)
    return _filled(rows, "due_date").drop("created_at")


@query
def invoice_date_range(spark, sf):
    rows = _listing(spark, sf, date_from="1997-02-01", date_to="1997-02-28")
    return _filled(rows, "due_date").drop("created_at")


@query
def invoice_page(spark, sf):
    """A deep page, from the listing in page order: one range of it is read and sorted."""
    at = fresh_dir(spark, "pages")
    reports.write_page_index(_listing(spark, sf, search="andina"), at)
    rows = reports.page_at(spark.read.parquet(at), limit=20, offset=1000)
    return rows.select("invoice_id", "number", "issue_date", "supplier_name", "total", "total_count")


@query
def invoice_detail(spark, sf):
    rows = reports.invoice_detail(
        derived.invoices(spark, sf), derived.suppliers(spark, sf), derived.items(spark, sf))
    return _filled(rows, "due_date", "address", "phone", "email")


@query
def invoice_stats(spark, sf):
    return reports.invoice_stats(derived.invoices(spark, sf))


@query
def job_counts(spark, sf):
    return reports.job_counts(derived.jobs(spark, sf))


@query
def dashboard(spark, sf):
    return reports.dashboard(derived.jobs(spark, sf), derived.invoices(spark, sf))


@query
def job_status(spark, sf):
    rows = reports.job_status(derived.jobs(spark, sf))
    return rows.withColumn(
        "duration_seconds", F.coalesce(F.col("duration_seconds").cast("long").cast("string"), F.lit("")))


@query
def failure_reasons(spark, sf):
    return reports.failure_reasons(derived.jobs(spark, sf))


# ------------------------------------------------------------------------ jobs
@query
def job_state_fold(spark, sf):
    folded = lifecycle.fold_jobs(derived.job_events(load(spark, sf, "events")))
    return _filled(folded, "error_message", "invoice_id").withColumns({
        c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")) for c in ("started_at", "finished_at")})


@query
def document_state_fold(spark, sf):
    return lifecycle.fold_documents(derived.job_events(load(spark, sf, "events")))


@query
def failure_disposition(spark, sf):
    return lifecycle.failure_disposition(derived.failures(spark, sf), lifecycle.taxonomy(spark))


@query
def stream_ingest(spark, sf):
    out, checkpoint = streams.scratch(spark, "ingest")
    arriving = derived.files(streams.table_stream(spark, sf, "documents"))
    streams.ingest_stream(arriving, out, checkpoint)
    documents, jobs = streams.ingested(spark, out)
    return documents.join(jobs.select("document_id", F.col("status").alias("job_status"), "attempts"),
                          "document_id")


def _arriving(spark, rows: DataFrame, source: str) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)


@query
def stream_process_once(spark, sf):
    """The ledger after two deliveries: even documents, then all of them; per document what became of it.

    Orders without lines have no printed invoice: their documents cannot be found.
    """
    out, checkpoint = streams.scratch(spark, "process")
    texts = f"{out}-texts"
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("document_id"))
    orders.join(_docs(spark, sf).withColumnRenamed("doc_id", "document_id"), "document_id", "left").select(
        "job_id", "document_id", "text").write.parquet(texts)
    rows = spark.read.parquet(texts)
    store = ledger.open_ledger(spark, out, buckets=8)
    for part in (rows.filter("document_id % 2 = 0"), rows):
        part.write.mode("append").parquet(f"{out}-source")
        ledger.ledger_stream(_arriving(spark, rows, f"{out}-source"), store, checkpoint, AS_OF)
    t = {name: store.read(name) for name in ledger.TABLES}
    lines = t["items"].groupBy("invoice_id").agg(F.count("*").alias("n_items"), F.sum("total").cast("decimal(20,2)").alias("items_total"))
    found = (
        t["documents"].join(t["jobs"].select("document_id", F.col("status").alias("job_status")), "document_id")
        .join(t["invoices"].select("invoice_id", "supplier_id", "number", "total"), "invoice_id", "left")
        .join(t["suppliers"].select("supplier_id", "tax_id"), "supplier_id", "left")
        .join(lines, "invoice_id", "left")
        .join(validate.validity(t["invoices"], t["issues"]), "invoice_id", "left")
    ).select("document_id", "status", "job_status", "code", "supplier_id", "tax_id", "number", "total", "n_items", "items_total",
             "is_valid", "n_issues")
    return _filled(found, "supplier_id", "tax_id", "number", "total", "n_items", "items_total", "is_valid", "n_issues")


@query
def stream_job_counts(spark, sf):
    """Jobs per status after the last batch, as counted up and down by the stream."""
    out, checkpoint = streams.scratch(spark, "counts")
    store = streams.event_store(spark, out, buckets=8)
    streams.fold_stream(derived.job_events(streams.table_stream(spark, sf, "events")), store, checkpoint)
    return store.read("counts")


@query
def stream_job_state(spark, sf):
    out, checkpoint = streams.scratch(spark, "states")
    store = streams.event_store(spark, out, buckets=8)
    streams.fold_stream(derived.job_events(streams.table_stream(spark, sf, "events")), store, checkpoint)
    return streams.folded_state(store).select("job_id", "status", "attempts", "illegal_events")
