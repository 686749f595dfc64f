"""Steps that every row passes: small enough to be compiled, and taken once."""

from __future__ import annotations

import re

import pytest

from ledgerloom.functions.text import trim_blank
from ledgerloom.operators.replies import recover_json
from ledgerloom.operators.rules import literal_of
from ledgerloom.plans.queries import QUERIES
from ledgerloom.sources import derived

# A JVM runs longer methods without compiling them.
MOST_BYTECODE = 8000


def _largest_method(spark, df) -> int:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan)))


def test_replies_are_printed_by_compiled_methods(spark, sf_dir):
    assert _largest_method(spark, derived.reply_texts(spark, sf_dir)) < MOST_BYTECODE


def test_replies_are_read_once_for_both_tables(spark, sf_dir):
    plan = QUERIES["build_invoice_tables"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "from_json" not in plan


BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


@pytest.mark.parametrize("text,kept", [
    (None, None), ("", ""), (BLANKS, ""), (BLANKS + "a" + BLANKS + "ñ" + BLANKS, "a" + BLANKS + "ñ"),
    ("​x᠎", "​x᠎"), ("﻿{}\n", "﻿{}"),
])
def test_trim_blank(rows, text, kept):
    assert rows([(text,)], "t string", lambda df: df.select(trim_blank(df.t).alias("t"))) == [{"t": kept}]


@pytest.mark.parametrize("content,outcome,found", [
    ('so: {"a":\n{"b":1}} {done', "object", '{"a":\n{"b":1}}'), ('so: {"a":\n{"b":1}}, done', "object", '{"a":\n{"b":1}}'),
    ("} no {", "malformed", None), ("{" * 50000 + "x", "malformed", None), ('x{"a":"' + "y" * 100000 + '"}', "object", None),
    ("[1]", "not_object", None), ("　  ", "malformed", None),
])
def test_outer_braces(rows, content, outcome, found):
    got = rows([(content, None)], "content string, reasoning string", recover_json)[0]
    assert got["outcome"] == outcome and (found is None or got["json"] == found)


def test_invoices_are_printed_by_compiled_methods(spark, sf_dir):
    assert _largest_method(spark, derived.invoice_texts(spark, sf_dir)) < MOST_BYTECODE


def test_a_pattern_is_matched_once(spark, sf_dir):
    plan = QUERIES["reconcile_subtotal"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract\(norm#\d+, \(\?Ud\)SUBTOTAL", plan)) == 1


def test_rules_look_for_what_tells_them_apart(spark):
    regexes = [r"TOTAL(?:ES)?\s+A\s+PAGAR", r"(?<!\w)TOTAL\s+VENTA", r"FECHAS?\s+DE\s+VENCIMIENTO", r"ABCDEFGHIJKL MNO", r"AB"]
    rows = spark.createDataFrame(list(enumerate(regexes)), "i int, regex string").orderBy("i")
    assert [r[0] for r in rows.select(literal_of(rows.regex)).collect()] == ["PAGAR", "VENTA", "VENCIMIENTO", "ABCDEFGHIJKL", ""]
