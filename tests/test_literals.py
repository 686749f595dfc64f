"""Quick looks before patterns: they may pass too much, never too little."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.operators.rules import DEFAULT_RULES, literal_of
from ledgerloom.plans.queries import QUERIES


def _literals(spark, patterns):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, regex string")
    return [r[0] for r in rows.orderBy("i").select(literal_of(F.col("regex"))).collect()]


def test_letters_that_every_match_holds(spark):
    cases = {
        r"(?Ud)REFERENCIA\s+DE\s+PAGO": "REFERENCIA", r"FECHAS?\s+DE\s+PAGO": "FECHA", r"(?Ud)(?<!\w)TOTAL(?:ES)?\s*": "TOTAL",
        r"(?:FACTURA|INVOICE)\b[^\n]{0,80}?NO": "", r"ABC|DEF": "", r"(ABC|DEF)XYZ": "XYZ", r"(?i)ABC": "", r"AB[CDE]": "",
        r"ABCD?": "ABC", r"ABC?DEFG": "DEFG", r"ABC{0}": "", r"(ABC)?": "", r"\x41ABC": "", r"\p{LUX}": "", r"\QABC?\E": "",
        r"[AB&&[ABC]XYZ]": "", r"[]XYZ]": "", r"\(ABC\)": "ABC", r"((((((ABC))))))?": "", r"[^)]ABC": "ABC", r"\[XYZ": "XYZ",
    }
    assert _literals(spark, cases) == list(cases.values())


def test_default_rules_have_letters(spark):
    got = dict(zip([r.name for r in DEFAULT_RULES], _literals(spark, [r.regex for r in DEFAULT_RULES])))
    assert {n for n, v in got.items() if not v} == {
        "generico_factura_no", "numero_prefijo_guion_linea", "numero_solo_prefijo_no", "fila_estructurada"}


def test_rules_look_for_their_letters_first(spark, sf_dir):
    """Without these looks every pattern ran over every text."""
    for name in ("extract_amounts", "extract_labelled_date", "route_extraction", "extract_currency"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Contains\(", plan), name
