"""The extraction contract as a set of column rules over payload tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import contract_amount
from ledgerloom.functions.binding import settle
from ledgerloom.functions.text import trim_blank
from ledgerloom.operators.rules import AGGREGATE_LINE

# Lengths and shapes of the contract.
NUMBER_SIZE, NAME_SIZE, TAX_ID_SIZE = (1, 100), (2, 255), (6, 64)
ADDRESS_MAX, PHONE_MAX, DESCRIPTION_SIZE = 500, 50, (1, 1000)
CURRENCY = r"^[A-Z]{3}$"
EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}(?:[T ]00:00(?::00(?:\.0+)?)?Z?)?$"


def _day(text: Column) -> Column:
    clean = trim_blank(text)
    return F.when(clean.rlike(ISO_DAY), F.try_to_date(F.left(clean, F.lit(10)), "yyyy-MM-dd"))


def _outside(text: Column, size: tuple[int, int]) -> Column:
    return F.coalesce(~F.length(text).between(*size), F.lit(True))


def _below(value: Column, least: int, strict: bool = False) -> Column:
    bad = value <= least if strict else value < least
    return F.coalesce(bad, F.lit(True))


def fill_items(payloads: DataFrame) -> DataFrame:
    """One aggregate item where none is given but a subtotal is."""
    missing = F.col("items").isNull() | (F.size("items") == 0)
    usable = F.col("subtotal").isNotNull() & ~F.col("subtotal").isin("", "0")
    tax = F.coalesce(F.nullif(F.col("tax"), F.lit("")), F.lit("0"))
    line = F.array(F.struct(
        F.lit(AGGREGATE_LINE).alias("description"), F.lit("1").alias("quantity"),
        F.col("subtotal").alias("unit_price"), tax.alias("tax"), F.col("subtotal").alias("total"),
    ))
    return payloads.withColumn("items", F.when(missing & usable, line).otherwise(F.col("items")))


def check_contract(payloads: DataFrame, key: str = "doc_id") -> DataFrame:
    """Coerce every payload and list the contract rules it breaks.

    Output: the coerced columns in payload form (``money`` and ``supplier`` as
    structs, ``items`` as an array), ``violations`` and ``is_valid``.
    """
    c = F.col
    zero = F.lit(0).cast("decimal(30,10)")

    def item(i: Column) -> Column:
        tax = F.when(i["tax"].isNull(), zero).otherwise(contract_amount(i["tax"]))
        return F.struct(
            i["description"].alias("description"),
            contract_amount(i["quantity"]).alias("quantity"),
            contract_amount(i["unit_price"]).alias("unit_price"),
            tax.alias("tax"),
            contract_amount(i["total"]).alias("total"),
        )

    s = c("supplier")
    coerced = payloads.select(
        key,
        trim_blank(c("number")).alias("number"),
        _day(F.coalesce("date", "issue_date")).alias("issue_date"),
        _day(c("due_date")).alias("due_date"),
        c("due_date").isNotNull().alias("_has_due"),
        F.upper(trim_blank(c("currency"))).alias("currency"),
        F.struct(
            contract_amount(c("subtotal")).alias("subtotal"),
            F.when(c("tax").isNull(), zero).otherwise(contract_amount(c("tax"))).alias("tax"),
            contract_amount(c("total")).alias("total"),
        ).alias("money"),
        F.when(s.isNotNull(), F.struct(*[
            trim_blank(s[f]).alias(f) for f in ("name", "tax_id", "address", "phone", "email")
        ])).alias("supplier"),
        F.transform("items", item).alias("items"),
    )
    return check_values(settle(coerced))


def check_values(coerced: DataFrame) -> DataFrame:
    """Contract rules over already typed payloads."""
    c = F.col
    has_due = c("_has_due") if "_has_due" in coerced.columns else c("due_date").isNotNull()
    items, money, s = c("items"), c("money"), c("supplier")

    def any_item(bad) -> Column:
        return F.coalesce(F.exists(items, bad), F.lit(False))

    def rule(name: str, broken: Column) -> Column:
        return F.when(broken, F.lit(name))

    violations = F.array_compact(F.array(
        rule("number", _outside(c("number"), NUMBER_SIZE)),
        rule("issue_date", c("issue_date").isNull()),
        rule("due_date", has_due & c("due_date").isNull()),
        rule("currency", F.coalesce(~c("currency").rlike(CURRENCY), F.lit(True))),
        rule("subtotal", _below(money["subtotal"], 0)),
        rule("tax", _below(money["tax"], 0)),
        rule("total", _below(money["total"], 0, strict=True)),
        rule("supplier", s.isNull()),
        rule("supplier.name", s.isNotNull() & _outside(s["name"], NAME_SIZE)),
        rule("supplier.tax_id", s.isNotNull() & _outside(s["tax_id"], TAX_ID_SIZE)),
        rule("supplier.address", F.length(s["address"]) > ADDRESS_MAX),
        rule("supplier.phone", F.length(s["phone"]) > PHONE_MAX),
        rule("supplier.email", ~s["email"].rlike(EMAIL)),
        rule("items", items.isNull() | (F.size(items) == 0)),
        rule("items.description", any_item(lambda i: _outside(i["description"], DESCRIPTION_SIZE))),
        rule("items.quantity", any_item(lambda i: _below(i["quantity"], 0))),
        rule("items.unit_price", any_item(lambda i: _below(i["unit_price"], 0))),
        rule("items.tax", any_item(lambda i: _below(i["tax"], 0))),
        rule("items.total", any_item(lambda i: _below(i["total"], 0, strict=True))),
        rule("due_before_issue", c("due_date") < c("issue_date")),
    ))
    return (
        settle(coerced.withColumn("violations", violations))
        .withColumn("is_valid", F.size("violations") == 0)
        .drop("_has_due")
    )
