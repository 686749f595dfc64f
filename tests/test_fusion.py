"""Replies, contract and merging."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

from ledgerloom.operators.contract import check_contract, fill_items
from ledgerloom.operators.extract import extract
from ledgerloom.operators.fusion import fuse_fallback, fuse_sources, rules_payload
from ledgerloom.operators.replies import payloads, recover_json

GOOD = {
    "number": " A-1 ", "date": "2026-01-02", "due_date": None, "currency": "cop", "subtotal": 100, "tax": "19,00",
    "total": "119", "supplier": {"name": "Beta SA", "tax_id": "900123456", "email": "a@b.co"},
    "items": [{"description": "x", "quantity": 1, "unit_price": "100", "total": 100.0}], "extra": 1,
}


def _with(**changes):
    return {**GOOD, **changes}


def test_recover_json(rows):
    body = json.dumps(GOOD)
    replies = {
        "bare": (body, None, "object"), "fence": (f"```json\n{body}\n```", None, "object"),
        "plain_fence": (f"```\n{body}```", None, "object"), "prose": (f"Sure: {body} ok?", None, "object"),
        "reasoning": ("  ", f"hmm {body}", "object"), "list": ("[1, 2]", None, "not_object"),
        "cut": (body[:-2], None, "malformed"), "empty": (None, None, "malformed"), "brace": ("} {", None, "malformed"),
    }
    out = rows([(k, v[0], v[1]) for k, v in replies.items()], "doc_id string, content string, reasoning string",
               recover_json)
    assert {r["doc_id"]: r["outcome"] for r in out} == {k: v[2] for k, v in replies.items()}
    assert all(json.loads(r["json"]) == GOOD for r in out if r["outcome"] == "object")


def _checked(df):
    return check_contract(fill_items(payloads(recover_json(df))))


def test_contract(rows):
    item = GOOD["items"][0]
    cases = {
        "good": (GOOD, []), "alias": ({k: v for k, v in _with(issue_date="2026-01-02").items() if k != "date"}, []),
        "no_supplier": (_with(supplier=None), ["supplier"]), "currency": (_with(currency="EURO"), ["currency"]),
        "due": (_with(due_date="2026-01-01"), ["due_before_issue"]), "bad_due": (_with(due_date="soon"), ["due_date"]),
        "quantity": (_with(items=[{**item, "quantity": "-1"}]), ["items.quantity"]),
        "no_items": (_with(items=[]), []), "no_items_no_subtotal": (_with(items=[], subtotal=""), ["items"]),
        "zero_text": (_with(items=[], subtotal="0.00"), ["items.total"]),
        "email": (_with(supplier={**GOOD["supplier"], "email": "nope"}), ["supplier.email"]),
        "number": (_with(number="  "), ["number"]), "total": (_with(total="1.234,56"), ["total"]),
        "tax_id": (_with(supplier={**GOOD["supplier"], "tax_id": " 123 "}), ["supplier.tax_id"]),
    }
    out = rows([(k, json.dumps(v[0]), None) for k, v in cases.items()],
               "doc_id string, content string, reasoning string", _checked)
    assert {r["doc_id"]: r["violations"] for r in out} == {k: v[1] for k, v in cases.items()}
    good = next(r for r in out if r["doc_id"] == "good")
    assert (good["number"], good["currency"], good["money"]["tax"]) == ("A-1", "COP", Decimal("19"))
    assert good["issue_date"] == date(2026, 1, 2)


PARTIAL = "Factura Electrónica de Venta JK5501\nFecha de Emisión: 22/10/2025\nTotal: COP 73.100\nMonto IVA: 11.671\n"
UNPRICED = "Factura Electrónica de Venta JK5501\nFecha de Emisión: 22/10/2025\nEmisor: Orilla Norte S.A.S\n"
LATE = "Factura Electrónica de Venta JK5501\nFecha de Emisión: 22/10/2025\nFecha de Vencimiento: 02/10/2025\n"


def test_fallback_fills_gaps(spark):
    docs = spark.createDataFrame(
        [("partial", PARTIAL), ("unpriced", UNPRICED), ("none", "nada"), ("alone", PARTIAL), ("late", LATE)],
        "doc_id string, text string")
    replies = spark.createDataFrame(
        [(k, json.dumps(GOOD), None) for k in ("partial", "unpriced", "none", "late")],
        "doc_id string, content string, reasoning string")
    got = {r.doc_id: r for r in fuse_fallback(rules_payload(extract(docs)), _checked(replies)).collect()}
    p = got["partial"]
    assert (p.outcome, p.number, p.supplier.name) == ("merged", "JK5501", "Beta SA")
    # The amounts come as one block from the rules, the lines from the fallback.
    assert (p.money.total, p.money.subtotal, p.money_from, p.items_from) == (73100, 61429, "rules", "fallback")
    u = got["unpriced"]
    assert (u.outcome, u.money.total, u.supplier.name, u.currency) == ("merged", 119, "ORILLA NORTE S.A.S", "COP")
    assert (got["none"].outcome, got["none"].number) == ("fallback", "A-1")
    assert (got["alone"].outcome, got["alone"].supplier) == ("PARTIAL", None)
    # Rules dates win and break the contract of the merged row.
    assert (got["late"].outcome, got["late"].violations) == ("ERROR", ["due_before_issue"])


def test_two_sources(spark):
    full = UNPRICED + "Total a pagar: COP 10.000\n"
    docs = spark.createDataFrame([
        ("embedded", full, full.replace("5501", "9999")), ("ocr", "nada", full), ("none", "nada", None),
        ("union", UNPRICED, "REFERENCIA DE PAGO: 777777\nTotal: COP 500\nMonto IVA: 80\n"),
        ("short", UNPRICED, ""), ("crash", full + "NIT 12\n", full),
    ], "doc_id string, embedded_text string, ocr_text string")
    got = {r.doc_id: r for r in fuse_sources(docs).collect()}
    assert (got["embedded"].outcome, got["embedded"].number) == ("FULL", "JK5501")
    assert (got["ocr"].outcome, got["ocr"].money.total) == ("FULL", 10000)
    assert got["none"].outcome == "NONE"
    u = got["union"]
    assert (u.outcome, u.number, u.money.total, u.money.subtotal, len(u["items"])) == ("FULL", "JK5501", 500, 420, 1)
    assert (got["short"].outcome, got["short"].missing_fields, got["short"]["items"]) == ("PARTIAL", ["total"], None)
    assert got["crash"].outcome == "ERROR"


def test_full_rows_pass_beside_the_join(spark):
    """Only what fell short is shuffled to the fallback rows."""
    docs = spark.createDataFrame([("full", UNPRICED + "Total a pagar: COP 10.000\n"), ("partial", PARTIAL)], "doc_id string, text string")
    replies = spark.createDataFrame([("partial", json.dumps(GOOD), None)], "doc_id string, content string, reasoning string")
    fused = fuse_fallback(rules_payload(extract(docs)), _checked(replies))
    plan = fused._jdf.queryExecution().executedPlan().toString()
    joined, beside = plan[plan.index("Union"):].split("PartitionFilters: [", 2)[1:]
    assert "route" in joined and "route" in beside
    assert "Exchange" not in beside.split("ReadSchema", 1)[1] and "REFERENCIA" not in plan
    assert {r.doc_id: r.outcome for r in fused.collect()} == {"full": "rules", "partial": "merged"}
