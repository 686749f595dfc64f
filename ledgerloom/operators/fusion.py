"""Merging extraction results of one document from several sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.binding import settle
from ledgerloom.operators.contract import check_values
from ledgerloom.operators.extract import aggregate_item, extract
from ledgerloom.operators.rules import DEFAULT_RULES, REQUIRED_FIELDS, Rule
from ledgerloom.session import stored

SUPPLIER = "struct<name:string,tax_id:string,address:string,phone:string,email:string>"
MONEY_BLOCK = "struct<subtotal:decimal(30,10),tax:decimal(30,10),total:decimal(30,10)>"
ITEMS = (
    "array<struct<description:string,quantity:decimal(30,10),unit_price:decimal(30,10),"
    "tax:decimal(30,10),total:decimal(30,10)>>"
)
FIELDS = ("number", "issue_date", "due_date", "currency", "money", "supplier", "items")


def rules_payload(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Extraction rows in payload form.

    The three amounts are one struct, present only when a total was found. An
    unsure currency and a synthesised line travel only with a FULL row.
    """
    full = F.col("route") == "FULL"
    s = F.col("supplier")
    money = F.struct("subtotal", "tax", "total").cast(MONEY_BLOCK)
    supplier = F.struct(
        s["name"].alias("name"), s["tax_id"].alias("tax_id"),
        *[F.lit(None).cast("string").alias(f) for f in ("address", "phone", "email")],
    )
    return rows.select(
        key, "route", "missing_fields", "number", "issue_date", "due_date",
        F.when(full | F.col("currency_confident"), F.col("currency")).alias("currency"),
        F.when(F.col("total").isNotNull(), money).alias("money"),
        F.when(s.isNotNull(), supplier).alias("supplier"),
        F.when(full, F.col("items")).when(F.size("item_rows") > 0, F.col("item_rows"))
        .cast(ITEMS).alias("items"),
    )


def fuse_fallback(rules: DataFrame, fallback: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rules first, the fallback's row or fields where the rules fell short.

    ``fallback`` holds contract-checked payloads. The extraction is stored once, by route; only documents
    that fell short are joined and so shuffled, all others pass beside the join. Each field, the money block,
    the supplier and the items move as wholes. ``provenance`` says where the row came from and
    ``money_from`` / ``items_from`` expose mixed rows.
    """
    f = fallback.filter("is_valid").select(key, F.struct(*FIELDS).alias("f"))
    held = stored(rules, "extracted", "route")
    short = F.coalesce(F.col("route").isin("PARTIAL", "NONE", "NO_ITEMS"), F.lit(False))
    filled = held.filter(short).join(f, key, "left")
    whole = held.filter(~short).withColumn("f", F.lit(None).cast(f.schema["f"].dataType))
    joined = filled.unionByName(whole)
    fb = F.col("f")
    partial = (F.col("route") == "PARTIAL") & fb.isNotNull()
    replaced = F.col("route").isin("NONE", "NO_ITEMS") & fb.isNotNull()

    def field(name: str) -> Column:
        return F.when(replaced, fb[name]).when(partial, F.coalesce(F.col(name), fb[name])).otherwise(F.col(name))

    def origin(name: str) -> Column:
        return (
            F.when(replaced | (partial & F.col(name).isNull()), F.lit("fallback"))
            .when(F.col(name).isNotNull(), F.lit("rules")).otherwise(F.lit("none"))
        )

    merged = joined.select(
        key, "route", partial.alias("_partial"), replaced.alias("_replaced"),
        *[field(n).alias(n) for n in FIELDS],
        origin("money").alias("money_from"), origin("items").alias("items_from"),
    )
    return check_values(settle(merged)).withColumn(
        "outcome",
        F.when(F.col("_replaced"), F.lit("fallback"))
        .when(F.col("_partial") & F.col("is_valid"), F.lit("merged"))
        .when(F.col("_partial"), F.lit("ERROR"))
        .when(F.col("route") == "FULL", F.lit("rules"))
        .otherwise(F.col("route")),
    ).drop("_partial", "_replaced")


def fuse_sources(
    docs: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, key: str = "doc_id"
) -> DataFrame:
    """One result per document from its embedded and its OCR text.

    A full embedded reading wins, then a full OCR reading, then the union of
    both: first source wins per field, the amounts follow the first source with
    a total. Both readings stay in the document's own row, so nothing is shuffled.
    The first reading is stored; only documents that it does not settle are read again.
    """
    rules = tuple(rules)
    names = ("route", *FIELDS)

    def reading(rows: DataFrame, text: str, keep: list[str], name: str) -> DataFrame:
        # A source that was never read or has no text finds nothing.
        carried = rows.select(key, *keep, F.col(text).alias("text"))
        payload = _with_carry(carried, keep, rules, key)
        return payload.select(key, *keep, F.struct(*names).alias(name))

    done = F.coalesce(F.col("a.route").isin("FULL", "ERROR"), F.lit(False))
    first = stored(reading(docs, "embedded_text", ["ocr_text"], "a").withColumn("_done", done), "embedded", "_done")
    second = reading(first.filter(~F.col("_done")), "ocr_text", ["a"], "b")
    # Without a second reading nothing is found in it, as in a document without OCR text.
    nothing = F.struct(F.lit("NONE").alias("route"), *[F.lit(None).cast(second.schema["b"].dataType[n].dataType).alias(n) for n in FIELDS])
    both = second.unionByName(first.filter("_done").select(key, "a", nothing.alias("b")))
    a, b = F.col("a"), F.col("b")
    settled = (
        F.when(a["route"].isin("FULL", "ERROR"), a["route"])
        .when(b["route"].isin("FULL", "ERROR"), b["route"])
    )
    use_a, use_b = a["route"] == "FULL", ~a["route"].isin("FULL", "ERROR") & (b["route"] == "FULL")

    def part(source: Column, name: str) -> Column:
        return F.when(source["route"] == "PARTIAL", source[name])

    def field(name: str) -> Column:
        return F.when(use_a, a[name]).when(use_b, b[name]).otherwise(
            F.coalesce(part(a, name), part(b, name)))

    rows = both.select(key, settled.alias("_settled"), *[field(n).alias(n) for n in FIELDS])
    empty = F.col("number").isNull()
    for n in FIELDS[1:]:
        empty = empty & F.col(n).isNull()
    subtotal = F.col("money.subtotal")
    rows = rows.withColumn("_empty", empty & F.col("_settled").isNull()).withColumn("_own", F.col("items"))
    rows = rows.withColumn(
        "items",
        F.when(F.col("items").isNull() & subtotal.isNotNull(),
               aggregate_item(subtotal, F.col("money.tax")).cast(ITEMS)).otherwise(F.col("items")),
    )
    present = {"total": F.col("money").isNotNull()}
    missing = F.array_compact(F.array(*[
        F.when(~present.get(f, F.col(f).isNotNull()), F.lit(f)) for f in REQUIRED_FIELDS
    ]))
    checked = check_values(settle(rows))
    outcome = (
        F.when(F.col("_settled").isNotNull(), F.col("_settled"))
        .when(F.col("_empty"), F.lit("NONE"))
        .when(F.col("is_valid"), F.lit("FULL"))
        .otherwise(F.lit("PARTIAL"))
    )
    # An incomplete union is handed on without the synthesised line.
    return checked.withColumn("outcome", outcome).withColumns({
        "missing_fields": F.when(outcome == "PARTIAL", missing).otherwise(F.array().cast("array<string>")),
        "items": F.when(outcome == "PARTIAL", F.col("_own")).otherwise(F.col("items")),
    }).drop("_settled", "_empty", "_own")


def _with_carry(rows: DataFrame, keep: list[str], rules: tuple[Rule, ...], key: str) -> DataFrame:
    """Rule payloads that keep further columns of the same row."""
    carried = rows.withColumn("_carry", F.struct(*keep)).drop(*keep)
    payload = extract(carried, rules)
    return rules_payload_keeping(payload, "_carry", key).select("*", "_carry.*").drop("_carry")


def rules_payload_keeping(rows: DataFrame, extra: str, key: str) -> DataFrame:
    return rules_payload(rows.withColumn("_id", F.struct(F.col(key), F.col(extra))), "_id").select(
        F.col(f"_id.{key}").alias(key), F.col(f"_id.{extra}").alias(extra), "route", "missing_fields",
        *FIELDS,
    )
