"""The ledger-writing run: arriving documents become suppliers, invoices, items, issues and final statuses.

Each micro-batch writes all tables and shows them by one commit record (``sources.store``), so a crash between
two writes, or a batch delivered again, leaves the same ledger. Suppliers, invoice keys, documents and jobs
already in the ledger are read from the buckets that the batch's keys fall in, never as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import persist, validate
from ledgerloom.operators.contract import check_values
from ledgerloom.operators.extract import extract
from ledgerloom.operators.fusion import ITEMS, MONEY_BLOCK, SUPPLIER, rules_payload
from ledgerloom.operators.rules import DEFAULT_RULES, Rule
from ledgerloom.sources.store import Batch, Store, Table
from ledgerloom.streaming.jobs import run_available

_PAYLOAD = (
    "document_id long, route string, number string, issue_date date, due_date date, currency string, "
    f"money {MONEY_BLOCK}, supplier {SUPPLIER}, items {ITEMS}, violations array<string>, is_valid boolean"
)
TABLES = {
    "documents": Table("document_id", "document_id long, status string, code string, invoice_id long"),
    "jobs": Table("job_id", "job_id long, document_id long, status string, code string, invoice_id long"),
    "payloads": Table("document_id", _PAYLOAD),
    "suppliers": Table("tax_id", "supplier_id long, tax_id string, name string, address string"),
    "invoices": Table(
        "supplier_id",
        "invoice_id long, document_id long, supplier_id long, number string, issue_date date, due_date date, currency string, "
        "subtotal decimal(14,2), tax_amount decimal(14,2), total decimal(14,2)",
    ),
    "items": Table(
        "invoice_id",
        "invoice_id long, position int, description string, quantity decimal(12,3), unit_price decimal(14,2), "
        "tax_amount decimal(14,2), total decimal(14,2)",
    ),
    "issues": Table(
        "invoice_id", "invoice_id long, rule_ord int, item int, code string, severity string, message string, field string"
    ),
}

# The code of a document that no invoice was made of, by how far extraction came.
ROUTE_CODES = {
    "PARTIAL": "llm_extraction_partial", "NONE": "llm_extraction_failed", "NO_ITEMS": "llm_extraction_failed",
    "ERROR": "document_processing_failed",
}
LOST, DUPLICATE, BROKEN = "document_not_found", "persistence_error", "document_processing_failed"


def open_ledger(spark: SparkSession, root: str, **options: int) -> Store:
    return Store(spark, root, TABLES, **options)


def _route_code(route: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in ROUTE_CODES.items() for x in pair])
    return F.coalesce(F.element_at(codes, route), F.lit(BROKEN))


def _suppliers(batch: Batch, accepted: DataFrame) -> DataFrame:
    """Suppliers of the accepted payloads, new ones numbered by the first document that shows them."""
    sightings = accepted.select(
        "document_id", F.col("document_id").alias("processed_at"), F.col("document_id").alias("doc_id"),
        F.col("supplier.name").alias("name"), F.col("supplier.address").alias("address"), F.trim("supplier.tax_id").alias("tax_id"),
    )
    known = batch.known("suppliers", sightings, "tax_id")
    new = persist.dedup_suppliers(sightings, known).withColumnRenamed("first_doc_id", "supplier_id")
    return known.unionByName(batch.append("suppliers", new))


def write_batch(store: Store, arriving: DataFrame, number: int, as_of: str, rules: Iterable[Rule] = DEFAULT_RULES) -> None:
    """Process one batch of jobs (job_id, document_id, text) and commit it.

    A job that is in the ledger is done; a document that is in it is not processed again, its further jobs end as it
    did. A null text is a document that cannot be found. Of a (supplier, number) the first invoice stays, in the order of
    document ids within a batch. Invalid invoices are stored with their issues, as the ledger keeps what was printed.
    """
    batch = store.begin(number)
    if batch is None:
        return
    jobs = arriving.select("job_id", "document_id").distinct()
    jobs = jobs.join(batch.known("jobs", jobs, "job_id").select("job_id"), "job_id", "left_anti")
    done = batch.known("documents", arriving, "document_id")
    todo = arriving.join(done.select("document_id"), "document_id", "left_anti")

    # Extracted once: everything below reads the payloads as stored.
    texts = todo.filter("text IS NOT NULL").groupBy("document_id").agg(F.max("text").alias("text"))
    read = rules_payload(extract(texts, rules), "document_id")
    payloads = batch.append("payloads", check_values(read))
    good = payloads.filter("route = 'FULL' AND is_valid").withColumnRenamed("document_id", "doc_id")
    unstorable = persist.unstorable(good).select("doc_id")
    good = good.join(unstorable, "doc_id", "left_anti")
    accepted = good.withColumnRenamed("doc_id", "document_id")
    suppliers = _suppliers(batch, accepted)

    head = persist.invoice_rows(good, suppliers).withColumn("invoice_id", F.col("document_id")).withColumn("created_at", F.col("document_id"))
    outcome = persist.reject_duplicates(head, batch.known("invoices", head, "supplier_id"))
    kept = batch.append("invoices", head.join(outcome.filter("outcome = 'kept'").select("invoice_id"), "invoice_id", "left_semi"))
    items = persist.item_rows(good).withColumnRenamed("document_id", "invoice_id")
    items = batch.append("items", items.join(kept.select("invoice_id"), "invoice_id", "left_semi"))
    batch.append("issues", validate.all_issues(kept, items, as_of))

    stored = kept.select("document_id", "invoice_id")
    ended = (
        todo.groupBy("document_id").agg((F.count("text") == 0).alias("lost"))
        .join(payloads.select("document_id", "route", "is_valid"), "document_id", "left")
        .join(good.select(F.col("doc_id").alias("document_id"), F.lit(True).alias("good")), "document_id", "left")
        .join(stored, "document_id", "left")
    )
    failed = (
        F.when(F.col("lost"), F.lit(LOST)).when(F.col("invoice_id").isNotNull(), F.lit(""))
        .when(F.col("good"), F.lit(DUPLICATE)).otherwise(_route_code(F.col("route")))
    )
    ended = batch.append("documents", ended.select(
        "document_id", F.when(F.col("invoice_id").isNotNull(), F.lit("PROCESSED")).otherwise(F.lit("FAILED")).alias("status"),
        failed.alias("code"), "invoice_id",
    ))
    of_document = done.unionByName(ended).select("document_id", "code", "invoice_id")
    batch.append("jobs", jobs.join(of_document, "document_id").select(
        "job_id", "document_id", F.when(F.col("invoice_id").isNotNull(), F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        "code", "invoice_id",
    ))
    batch.commit()


def ledger_stream(arriving: DataFrame, store: Store, checkpoint: str, as_of: str, rules: Iterable[Rule] = DEFAULT_RULES) -> None:
    """Process all arriving jobs, micro-batch by micro-batch."""
    rules = tuple(rules)
    run_available(arriving, lambda rows, number: write_batch(store, rows, number, as_of, rules), checkpoint)
