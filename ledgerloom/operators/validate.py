"""Business checks over invoices and their items, and the resulting reports.

Issues are built in the long form (one row each, ordered by rule and item), so
no check ever gathers the lines of one invoice in one place.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import MONEY

# Tolerances and day limits.
TOLERANCE = Decimal("5")
LINE_TOLERANCE = Decimal("0.02")
PER_ITEM_BAND = Decimal("0.01")
FUTURE_DAYS = 1
FAR_FUTURE_DAYS = 365
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"

_WHOLE_INVOICE = -1


def _issue(when: Column, order: int, code: str, severity, message: Column, field, item=None) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(when, F.struct(
        F.lit(order).alias("rule_ord"),
        (item if item is not None else F.lit(_WHOLE_INVOICE)).cast("int").alias("item"),
        F.lit(code).alias("code"), as_col(severity).alias("severity"),
        as_col(message).alias("message"), as_col(field).alias("field"),
    ))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _explode(rows: DataFrame, key: str, issues: list[Column]) -> DataFrame:
    return rows.select(key, F.inline(F.array_compact(F.array(*issues))))


# ----------------------------------------------------------------- line totals
def line_net() -> Column:
    """quantity x price; wide enough for any product of the two."""
    return F.round(F.col("quantity") * F.col("unit_price"), 2).cast("decimal(24,2)")


def item_sums(items: DataFrame) -> DataFrame:
    """Per invoice: number of lines and the sum of their totals."""
    return items.groupBy("invoice_id").agg(
        F.count("*").alias("n_items"), F.sum("total").try_cast("decimal(28,2)").alias("items_total")
    )


def line_totals(items: DataFrame) -> DataFrame:
    """Per invoice: lines, sum of totals and sum of quantity x price."""
    return items.withColumn("line_net", line_net()).groupBy("invoice_id").agg(
        F.count("*").alias("n_items"),
        F.sum("total").try_cast("decimal(28,2)").alias("items_total"),
        F.sum("line_net").try_cast("decimal(28,2)").alias("net_total"),
    )


# --------------------------------------------------------------------- checks
def required_issues() -> list[Column]:
    return [
        _issue(F.trim("number") == "", 1, "required.number", ERROR,
               F.lit("Invoice number is missing"), "number"),
        _issue(F.col("supplier_id").isNull(), 1, "required.supplier", ERROR,
               F.lit("Supplier reference is missing"), "supplier"),
    ]


def date_issues(as_of: str) -> list[Column]:
    issue, due = F.col("issue_date"), F.col("due_date")
    ahead = F.datediff(issue, F.lit(as_of).cast("date"))
    return [
        _issue(ahead > FAR_FUTURE_DAYS, 2, "date.issue_far_future", WARNING,
               _text("Issue date ", issue, " is more than one year ahead"), "issue_date"),
        _issue((ahead > FUTURE_DAYS) & (ahead <= FAR_FUTURE_DAYS), 2, "date.issue_future", INFO,
               _text("Issue date ", issue, " lies in the future"), "issue_date"),
        _issue(due < issue, 3, "date.due_before_issue", ERROR,
               _text("Due date ", due, " precedes issue date ", issue), "due_date"),
    ]


def range_issues() -> list[Column]:
    return [
        _issue(F.col("subtotal") < 0, 4, "range.subtotal_negative", ERROR,
               F.lit("Subtotal cannot be negative"), "subtotal"),
        _issue(F.col("tax_amount") < 0, 5, "range.tax_negative", ERROR,
               F.lit("Tax cannot be negative"), "tax"),
        _issue(F.col("total") <= 0, 6, "range.total_positive", ERROR,
               F.lit("Total must be greater than zero"), "total"),
    ]


def quantity_issues() -> list[Column]:
    at = F.col("position")
    return [_issue(F.col("quantity") <= 0, 7, "range.item_quantity", ERROR,
                   _text("Item #", at + 1, " quantity must be positive"),
                   _text("items[", at, "].quantity"), at)]


def total_issues(tolerance: Decimal = TOLERANCE) -> list[Column]:
    subtotal, tax, total = F.col("subtotal"), F.col("tax_amount"), F.col("total")
    gap = subtotal + tax - total
    return [_issue(F.abs(gap) > F.lit(tolerance), 8, "math.total_mismatch", ERROR,
                   _text("subtotal (", subtotal, ") + tax (", tax, ") != total (", total,
                         ") [diff ", gap, "]"), "total")]


def item_sum_issues(tolerance: Decimal = TOLERANCE) -> list[Column]:
    """Needs the ``n_items`` and ``items_total`` of ``item_sums``."""
    n, items_total, subtotal = F.col("n_items"), F.col("items_total"), F.col("subtotal")
    gap = F.abs(items_total - subtotal)
    severity = F.when(gap > F.lit(PER_ITEM_BAND) * n.cast("decimal(18,0)"), F.lit(ERROR)).otherwise(
        F.lit(WARNING)
    )
    return [
        _issue(n.isNull(), 9, "items.empty", ERROR, F.lit("Invoice has no line items"), "items"),
        _issue(gap > F.lit(tolerance), 10, "math.items_subtotal_mismatch", severity,
               _text("Sum of line totals (", items_total, ") differs from subtotal (", subtotal, ")"),
               "subtotal"),
    ]


def line_issues() -> list[Column]:
    at, total, net = F.col("position"), F.col("total"), F.col("line_net")
    gap, field = F.abs(total - net), _text("items[", at, "].total")
    return [
        _issue(gap > F.lit(LINE_TOLERANCE), 11, "math.item_line_mismatch", ERROR,
               _text("Item #", at + 1, ": quantity(", F.col("quantity"), ") x unit_price(",
                     F.col("unit_price"), ") != line total (", total, ")"), field, at),
        _issue((gap > 0) & (gap <= F.lit(LINE_TOLERANCE)), 11, "math.item_line_rounding", WARNING,
               _text("Item #", at + 1, ": line total (", total,
                     ") differs from quantity x unit_price (", net, ") by rounding"), field, at),
    ]


def header_check(invoices: DataFrame, issues: list[Column]) -> DataFrame:
    return _explode(invoices, "invoice_id", issues)


def item_check(items: DataFrame, issues: list[Column]) -> DataFrame:
    return _explode(items.withColumn("line_net", line_net()), "invoice_id", issues)


def with_item_sums(invoices: DataFrame, items: DataFrame) -> DataFrame:
    return invoices.join(item_sums(items), "invoice_id", "left")


def all_issues(
    invoices: DataFrame, items: DataFrame, as_of: str, tolerance: Decimal = TOLERANCE
) -> DataFrame:
    """Every issue of every invoice, one row each."""
    header = required_issues() + date_issues(as_of) + range_issues() + total_issues(tolerance)
    return header_check(
        with_item_sums(invoices, items), header + item_sum_issues(tolerance)
    ).unionByName(item_check(items, quantity_issues() + line_issues()))


# -------------------------------------------------------------------- reports
def validity(invoices: DataFrame, issues: DataFrame) -> DataFrame:
    """Per invoice: is_valid and the issue counts; clean invoices included."""
    counts = issues.groupBy("invoice_id").agg(
        F.count("*").alias("n_issues"), F.count_if(F.col("severity") == ERROR).alias("n_errors")
    )
    return invoices.select("invoice_id").join(counts, "invoice_id", "left").select(
        "invoice_id",
        (F.coalesce("n_errors", F.lit(0)) == 0).alias("is_valid"),
        F.coalesce("n_issues", F.lit(0)).alias("n_issues"),
    )


def validation_report(invoices: DataFrame, issues: DataFrame) -> DataFrame:
    """Report in the long form: a row per issue, and one with empty issue columns for a clean invoice.

    ``is_valid`` stands on every row; rows of an invoice are ordered by (rule_ord, item). An invoice
    with any number of lines is never gathered in one row.
    """
    errors = issues.groupBy("invoice_id").agg(F.count_if(F.col("severity") == ERROR).alias("errors"))
    return (
        invoices.select("invoice_id")
        .join(errors, "invoice_id", "left")
        .join(issues.select("invoice_id", "rule_ord", "item", "code", "severity", "message", "field"), "invoice_id", "left")
        .select(
            "invoice_id", (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"),
            "rule_ord", "item", "code", "severity", "message", "field",
        )
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity and code, in display order."""
    return issues.groupBy("severity", "code").agg(
        F.count("*").alias("n_issues")
    ).orderBy("severity", "code")


def entity_faults(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Invoices an entity would refuse, with every reason."""
    c = F.col
    checked = with_item_sums(invoices, items)
    faults = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("number"), F.lit("")) == "", F.lit("invoice.number")),
        F.when((F.length("currency") != 3) | (F.upper("currency") != c("currency"))
               | ~c("currency").rlike("[A-Z]"), F.lit("invoice.currency")),
        F.when(c("n_items").isNull(), F.lit("invoice.items")),
        F.when(c("total") <= 0, F.lit("invoice.total")),
    ))
    return checked.select("invoice_id", faults.alias("faults")).filter(F.size("faults") > 0)


def supplier_faults(suppliers: DataFrame) -> DataFrame:
    faults = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("supplier.name")),
        F.when(F.coalesce(F.trim("tax_id"), F.lit("")) == "", F.lit("supplier.tax_id")),
    ))
    return suppliers.select("supplier_id", faults.alias("faults")).filter(F.size("faults") > 0)


def document_faults(documents: DataFrame) -> DataFrame:
    faults = F.array_compact(F.array(
        F.when(F.col("size_bytes") < 0, F.lit("document.size_bytes")),
        F.when(F.coalesce("filename", F.lit("")) == "", F.lit("document.filename")),
    ))
    return documents.select("document_id", faults.alias("faults")).filter(F.size("faults") > 0)
