"""Search, paging, detail and dashboard queries over the ledger."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_LIMITS = (1, 100)
#: Order of pages, each column from the newest down.
NEWEST = ("issue_date", "created_at", "invoice_id")
UNKNOWN_SUPPLIER = "(unknown)"
SUMMARY = (
    "invoice_id", "document_id", "number", "issue_date", "due_date", "currency",
    "subtotal", "tax_amount", "total", "supplier_name", "supplier_tax_id",
)


def _pattern(search: str) -> str:
    # A backslash in front of an ordinary character means that character.
    return "%" + re.sub(r"\\([^%_\\])", r"\1", search.strip()) + "%"


def _by_key(suppliers: DataFrame) -> DataFrame:
    """One row per supplier key, so that a repeated key cannot multiply invoices."""
    rest = [c for c in suppliers.columns if c != "supplier_id"]
    first = F.min(F.struct(*rest)).alias("s")
    return suppliers.groupBy("supplier_id").agg(first).select("supplier_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def listing(
    invoices: DataFrame,
    suppliers: DataFrame,
    search: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Flat listing; date bounds reach the invoice scan, missing suppliers read ''."""
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from must not exceed date_to")
    rows = invoices
    if date_from:
        rows = rows.filter(F.col("issue_date") >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.filter(F.col("issue_date") <= F.lit(date_to).cast("date"))
    names = _by_key(suppliers).select(
        "supplier_id", F.col("name").alias("supplier_name"), F.col("tax_id").alias("supplier_tax_id")
    )
    rows = rows.join(names, "supplier_id", "left")
    if search:
        like = _pattern(search)
        rows = rows.filter(
            F.col("number").ilike(like) | F.col("supplier_name").ilike(like)
            | F.col("supplier_tax_id").ilike(like)
        )
    return rows.withColumns({
        c: F.coalesce(c, F.lit("")) for c in ("supplier_name", "supplier_tax_id")
    }).select(*SUMMARY, "created_at")


def _newest() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST]


def _check_page(limit: int, offset: int) -> None:
    if not PAGE_LIMITS[0] <= limit <= PAGE_LIMITS[1]:
        raise ValueError("limit must be within [1, 100]")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def page(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, newest first, each row with the count of the whole filtered set.

    The order ends with the id, so pages never overlap. Sorting keeps only the top offset+limit rows per
    task, so this is for the first pages; ``page_at`` and ``page_after`` reach any depth.
    """
    _check_page(limit, offset)
    top = rows.orderBy(*_newest()).offset(offset).limit(limit)
    return top.withColumn("total_count", rows.agg(F.count("*")).scalar())


def write_page_index(rows: DataFrame, path: str, ranges: int | None = None) -> None:
    """A listing in page order: sampled ranges of the sort key, a folder each, newest first."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartitionByRange(ranges, *_newest()).withColumn("page_range", F.spark_partition_id())
        .write.mode("overwrite").partitionBy("page_range").parquet(path)
    )


def page_at(index: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page at any depth: only the ranges that hold it are read, sorted and cut.

    ``index`` is what ``write_page_index`` wrote. The sizes of its ranges come to the driver, a number a range.
    """
    _check_page(limit, offset)
    sizes = index.groupBy("page_range").agg(F.count("*").alias("n")).orderBy("page_range").collect()
    total, before, wanted = sum(r["n"] for r in sizes), 0, []
    skip = 0
    for r in sizes:
        if before + r["n"] > offset and before < offset + limit:
            skip = skip if wanted else offset - before
            wanted.append(r["page_range"])
        before += r["n"]
    held = index.filter(F.col("page_range").isin(wanted)).drop("page_range")
    return held.orderBy(*_newest()).offset(skip).limit(limit).withColumn("total_count", F.lit(total).cast("long"))


def page_after(rows: DataFrame, last: tuple, limit: int = 20) -> DataFrame:
    """The page after a row given by its (issue_date, created_at, invoice_id); the date bound reaches the scan."""
    _check_page(limit, 0)
    day, made, number = (F.lit(v) for v in last)
    older = F.struct(*NEWEST) < F.struct(day.alias("issue_date"), made.alias("created_at"), number.alias("invoice_id"))
    return rows.filter((F.col("issue_date") <= day) & older).orderBy(*_newest()).limit(limit)


# ----------------------------------------------------------------- search index
def _trigrams(text: Column) -> Column:
    """Different runs of three characters of a lower-cased text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(low, i, F.lit(3))), lambda g: F.length(g) == 3))


def write_search_index(invoices: DataFrame, suppliers: DataFrame, path: str, buckets: int = 64) -> None:
    """Where each run of three characters occurs: numbers by invoice, names and tax ids by supplier.

    The rows lie in folders by a hash of the run, so a search reads the folders of its own runs only.
    """

    def of(rows: DataFrame, field: str, key: str, text: str) -> DataFrame:
        return rows.select(F.lit(field).alias("field"), F.col(key).cast("long").alias("id"), F.explode(_trigrams(F.col(text))).alias("gram"))

    grams = (
        of(invoices, "number", "invoice_id", "number").unionByName(of(suppliers, "name", "supplier_id", "name"))
        .unionByName(of(suppliers, "tax_id", "supplier_id", "tax_id")).distinct()
    )
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    grams.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_grams(search: str) -> list[str]:
    """Runs of three characters that any match of a search text must hold; none for short or wild ones."""
    literal = re.sub(r"\\([%_\\])", lambda m: m.group(1) if m.group(1) not in "%_" else "\0", _pattern(search)[1:-1])
    runs = re.split(r"[%_\0]", literal.lower())
    return sorted({run[i:i + 3] for run in runs for i in range(len(run) - 2)})


def listing_by_index(
    invoices: DataFrame, suppliers: DataFrame, index: DataFrame, search: str, buckets: int = 64, **dates: str | None
) -> DataFrame:
    """``listing`` with a search text, over the invoices that the index cannot rule out.

    A field that matches holds every run of the text's literal parts; those that do are joined to the
    invoices, and the search itself then decides. A text without three literal characters in a row is searched by a scan.
    """
    grams = search_grams(search)
    if not grams:
        return listing(invoices, suppliers, search, **dates)
    rows = invoices.sparkSession.createDataFrame([(g,) for g in grams], "gram string")
    own = [r[0] for r in rows.select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct().collect()]
    held = (
        index.filter(F.col("bucket").isin(own) & F.col("gram").isin(grams))
        .groupBy("field", "id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    )
    by_number = held.filter("field = 'number'").select(F.col("id").alias("invoice_id"))
    by_supplier = held.filter("field <> 'number'").select(F.col("id").alias("supplier_id")).distinct()
    near = (
        invoices.join(by_number, "invoice_id", "left_semi").unionByName(invoices.join(by_supplier, "supplier_id", "left_semi")).distinct()
    )
    return listing(near, suppliers, search, **dates)


def invoice_detail(invoices: DataFrame, suppliers: DataFrame, items: DataFrame) -> DataFrame:
    """Invoice, supplier and item, a row per item; an invoice without items has one row without.

    The same shape at any size: no invoice's items are gathered in one row. Rows of an invoice are
    ordered by ``position``.
    """
    who = _by_key(suppliers).select(
        "supplier_id", F.col("name").alias("_name"), F.col("tax_id").alias("_tax"),
        "address", "phone", "email",
    )
    lines = items.select(
        "invoice_id", "position", "description", "quantity", "unit_price",
        F.col("tax_amount").alias("item_tax"), F.col("total").alias("item_total"),
    )
    return (
        invoices.join(who, "supplier_id", "left")
        .join(lines, "invoice_id", "left")
        .select(
            "invoice_id", "document_id", "number", "issue_date", "due_date", "currency",
            "subtotal", "tax_amount", "total",
            F.coalesce("_name", F.lit(UNKNOWN_SUPPLIER)).alias("supplier_name"),
            F.coalesce("_tax", F.lit("")).alias("supplier_tax_id"),
            "address", "phone", "email",
            "position", "description", "quantity", "unit_price", "item_tax", "item_total",
        )
    )


def _stats() -> list[Column]:
    return [
        F.count("*").alias("total_invoices"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(24,2)").alias("total_invoiced"),
    ]


def invoice_stats(invoices: DataFrame) -> DataFrame:
    """Number of invoices and their sum, across currencies as printed."""
    return invoices.agg(*_stats())


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"))


def dashboard(jobs: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row: jobs per state and the invoice totals."""
    stats = invoice_stats(invoices)
    return jobs.agg(*[
        F.count_if(F.col("status") == s).alias(f"{s.lower()}_jobs")
        for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
    ]).withColumns({c: stats.select(c).scalar() for c in stats.columns})


def job_status(jobs: DataFrame) -> DataFrame:
    """Job rows with whole-second precision duration and a terminal flag."""
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    return jobs.select(
        "job_id", "document_id", "status", "attempts",
        (micros / 1000000.0).alias("duration_seconds"),
        F.col("status").isin("COMPLETED", "FAILED").alias("is_terminal"),
    )


def failure_reasons(jobs: DataFrame) -> DataFrame:
    """Single reasons inside the error messages of failed jobs, counted."""
    parts = F.split(F.coalesce("error_message", F.lit("unknown error")), "; ")
    reason = F.explode(F.filter(parts, lambda p: F.trim(p) != "")).alias("part")
    return (
        jobs.filter("status = 'FAILED'")
        .select(reason)
        .select(F.btrim("part", F.lit(" .")).alias("reason"))
        .groupBy("reason").agg(F.count("*").alias("n_jobs"))
    )


def lookup(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows of a table for a table of keys (missing keys are absent)."""
    return table.join(keys.select(on).distinct(), on, "left_semi")


def supplier_by_tax_id(keys: DataFrame, suppliers: DataFrame) -> DataFrame:
    wanted = keys.select(F.trim("tax_id").alias("tax_id")).distinct()
    return suppliers.join(wanted, "tax_id", "left_semi")


def latest_by_document(invoices: DataFrame) -> DataFrame:
    """The newest invoice of each document, by partial aggregation."""
    return invoices.groupBy("document_id").agg(
        F.max(F.struct("created_at", "invoice_id")).alias("m")
    ).select("document_id", F.col("m.invoice_id").alias("invoice_id"), F.col("m.created_at").alias("created_at"))
