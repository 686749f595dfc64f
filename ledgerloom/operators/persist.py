"""Ledger writing rules: suppliers once, invoices once, documents once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import MONEY, QUANTITY


def dedup_suppliers(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One supplier per trimmed tax id; the first processed sighting wins.

    ``min_by`` keeps one row per key on the map side, so a tax id that fills a
    third of the input costs its reducer one row per map task.
    """
    block = F.struct("name", "address", "doc_id")
    first = (
        sightings.withColumn("tax_id", F.trim("tax_id"))
        .groupBy("tax_id")
        .agg(F.min_by(block, F.struct("processed_at", "doc_id")).alias("s"))
        .select("tax_id", "s.name", "s.address", F.col("s.doc_id").alias("first_doc_id"))
    )
    return first if known is None else first.join(known.select("tax_id"), "tax_id", "left_anti")


def reject_duplicates(invoices: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Mark the first invoice per (supplier, number) as kept, the others as rejected.

    Any invoice whose (supplier, number) is among the ``stored`` ones is rejected. Winners come from
    a partial aggregation and are joined back on the unique invoice id, never on the possibly
    crowded (supplier, number).
    """
    fresh = invoices
    if stored is not None:
        fresh = invoices.join(stored.select("supplier_id", "number").distinct(), ["supplier_id", "number"], "left_anti")
    kept = (
        fresh.groupBy("supplier_id", "number")
        .agg(F.min(F.struct("created_at", "invoice_id")).alias("w"))
        .select(F.col("w.invoice_id").alias("invoice_id"), F.lit(True).alias("kept"))
    )
    rejected = F.col("kept").isNull()
    return invoices.join(kept, "invoice_id", "left").select(
        "invoice_id", "supplier_id", "number",
        F.when(rejected, F.lit("rejected")).otherwise(F.lit("kept")).alias("outcome"),
        F.when(rejected, F.lit("persistence_error")).otherwise(F.lit("")).alias("code"),
        F.lit(False).alias("retryable"),
    )


def next_action(jobs: DataFrame, invoices: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """What to do with each job: skip, resume on the stored invoice, process, or refuse; one row a job.

    Of several invoices of a document the latest counts. A failed job cannot be completed against a
    stored invoice and is refused. With ``documents``, a job whose document is not among them is
    ``document_not_found``.
    """
    last = invoices.groupBy("document_id").agg(F.max(F.struct("created_at", "invoice_id")).alias("last"))
    known = jobs.join(last.select("document_id", F.col("last.invoice_id").alias("stored_invoice_id")), "document_id", "left")
    lost = F.lit(False)
    if documents is not None:
        there = documents.select("document_id").distinct().withColumn("there", F.lit(True))
        known, lost = known.join(there, "document_id", "left"), F.col("there").isNull()
    has = F.col("stored_invoice_id").isNotNull()
    return known.select(
        "job_id", "document_id", "stored_invoice_id",
        F.when(F.col("status") == "COMPLETED", F.lit("skip"))
        .when(lost, F.lit("document_not_found"))
        .when(has & (F.col("status") == "FAILED"), F.lit("refuse"))
        .when(has, F.lit("resume"))
        .otherwise(F.lit("process")).alias("action"),
    )


def to_process(documents: DataFrame, invoices: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents without a stored invoice."""
    return documents.join(invoices.select(key), key, "left_anti")


def _money(column: str):
    return F.round(column, 2).try_cast(MONEY)


def unstorable(payloads: DataFrame) -> DataFrame:
    """Payloads with an amount that the ledger's columns cannot hold, as (doc_id, code)."""
    parts = [F.col(f"money.{f}").isNotNull() & _money(f"money.{f}").isNull() for f in ("subtotal", "tax", "total")]
    lines = F.exists("items", lambda i: (
        (i["quantity"].isNotNull() & F.round(i["quantity"], 3).try_cast(QUANTITY).isNull())
        | (i["unit_price"].isNotNull() & F.round(i["unit_price"], 2).try_cast(MONEY).isNull())
        | (i["tax"].isNotNull() & F.round(i["tax"], 2).try_cast(MONEY).isNull())
        | (i["total"].isNotNull() & F.round(i["total"], 2).try_cast(MONEY).isNull())
    ))
    bad = parts[0] | parts[1] | parts[2] | F.coalesce(lines, F.lit(False))
    return payloads.filter(bad).select("doc_id", F.lit("amount_out_of_range").alias("code"))


def invoice_rows(payloads: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Extraction payloads to invoice rows, supplier key resolved by trimmed tax id.

    One row a payload, also where suppliers repeat a tax id (the smallest key counts). An amount the
    ledger cannot hold is NULL; ``unstorable`` lists those payloads.
    """
    keys = suppliers.groupBy(F.trim("tax_id").alias("_tax_id")).agg(F.min("supplier_id").alias("supplier_id"))
    return payloads.join(keys, F.trim(F.col("supplier.tax_id")) == F.col("_tax_id"), "left").select(
        F.col("doc_id").alias("document_id"), "supplier_id", "number", "issue_date", "due_date",
        "currency",
        _money("money.subtotal").alias("subtotal"),
        _money("money.tax").alias("tax_amount"),
        _money("money.total").alias("total"),
    )


def item_rows(payloads: DataFrame) -> DataFrame:
    """Extraction payloads to item rows with 0-based positions."""
    return payloads.select(F.col("doc_id").alias("document_id"), F.posexplode("items").alias("position", "i")).select(
        "document_id", "position", F.col("i.description").alias("description"),
        F.round("i.quantity", 3).try_cast(QUANTITY).alias("quantity"),
        _money("i.unit_price").alias("unit_price"),
        _money("i.tax").alias("tax_amount"),
        _money("i.total").alias("total"),
    )


def audit_payload(payloads: DataFrame) -> DataFrame:
    """The whole extraction as JSON text (ISO dates), one per document."""
    body = F.struct(
        "number", F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"),
        F.date_format("due_date", "yyyy-MM-dd").alias("due_date"), "currency",
        *[F.col(f"money.{f}").try_cast("decimal(20,2)").cast("string").alias(f) for f in ("subtotal", "tax", "total")],
        "supplier",
        F.transform("items", lambda i: F.struct(
            i["description"].alias("description"),
            *[i[f].try_cast("decimal(20,2)").cast("string").alias(f)
              for f in ("quantity", "unit_price", "tax", "total")],
        )).alias("items"),
    )
    return payloads.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("raw_extraction"))
