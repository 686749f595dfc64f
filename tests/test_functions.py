"""Column expressions on literal values."""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.amounts import contract_amount, latam_amount, ledger_money
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.text import markup_lines, normalize_text, safe_filename
from ledgerloom.plans.queries import QUERIES


def _values(rows, raws, fn):
    out = rows(
        list(enumerate(raws)), "i int, raw string",
        lambda df: df.select("i", fn(F.col("raw")).alias("v")).orderBy("i"),
    )
    return [r["v"] for r in out]


def _money(values):
    return [None if v is None else Decimal(v) for v in values]


def test_normalize(rows):
    pairs = {
        "Liquidación ANUAL": "LIQUIDACION ANUAL",
        "a\tb   c\n  d  \n": "A B C\nD",
        "A\n\n\nB\n": "A\nB",
        "A\u00a0B \u2013 \u201cx\u201d \u2019\u2026": "A B - \"X\" '...",
        "FFFECHAAA DE PAGOOO": "FECHA DE PAGO",
        "CALLLE CALLE PERRO ACCION PASSO": "CALE CALLE PERRO ACCION PASSO",
        "REF 111222333": "REF 111222333",
        "a\r\nb\x0bc\u2028d\x85e": "A\nB\nC\nD\nE",
        "\ufb01n \u00bd \u2122": "FIN 1\u20442 TM",
        "stra\u00dfe": "STRASSE",
        "": "",
    }
    assert _values(rows, list(pairs), normalize_text) == list(pairs.values())


def test_three_amount_readings(rows):
    table = {
        # raw: (extracted, contract, ledger)
        "$63,204.19": ("63204.19", None, None),
        "1,234": ("1234.00", "1.234", "1.23"),
        "50.000": ("50000.00", "50", "50.00"),
        "1.234,56": ("1234.56", None, "1234.56"),
        "12,5": ("125.00", "12.5", "12.50"),
        "12,50": ("12.50", "12.5", "12.50"),
        "63204.19.": (None, None, None),
        "415000.5": ("415000.50", "415000.5", "415000.50"),
        "abc": (None, None, None),
        "1.2.3": (None, None, None),
        "-5": ("-5.00", "-5", None),
        "": (None, "0", None),
        "10.005": ("10005.00", "10.005", "10.01"),
        "0.125": ("125.00", "0.125", "0.13"),
        "COP 415,000.00": ("415000.00", None, None),
        "NaN": (None, None, None),
    }
    raws = list(table)
    for n, reading in enumerate((latam_amount, contract_amount, ledger_money)):
        expected = _money([table[r][n] for r in raws])
        assert _money(_values(rows, raws, reading)) == expected


def test_missing_ledger_money_is_zero(rows):
    assert _values(rows, [None], ledger_money) == [Decimal("0.00")]
    assert _values(rows, ["2.345", "2.355"], latam_amount) == [Decimal("2345.00"), Decimal("2355.00")]


def test_parse_date(rows):
    pairs = {
        "27/02/2025 07:05 PM": date(2025, 2, 27),
        "2025-10-09": date(2025, 10, 9),
        "2020-01-05 O 06/01/2020": date(2020, 1, 6),
        "30/02/2020 2020-01-05": None,
        "16-SEP-2025": date(2025, 9, 16),
        "16-SEPT-2025": date(2025, 9, 16),
        "06-ENE-2025 A 05-FEB-2025": date(2025, 1, 6),
        "16-XXX-2025": None,
        "2025-10-091": None,
        "7/3/2025": date(2025, 3, 7),
        "SIN FECHA": None,
    }
    assert _values(rows, list(pairs), parse_date) == list(pairs.values())


def test_safe_filename(rows):
    pairs = {
        "C:\\tmp\\fáctura (1).pdf": "factura__1_.pdf",
        "../../etc/passwd": "passwd",
        "...": "document",
        "dir/": "document",
        "señal-2_b.PNG": "senal-2_b.PNG",
    }
    assert _values(rows, list(pairs), safe_filename) == list(pairs.values())


def test_markup_lines(rows):
    out = rows([(1, "<p>a</p>\n---\n<td> $1 </td><td></td>x")], "k int, h string",
               lambda df: markup_lines(df, "k", "h").orderBy("line_no"))
    assert [r["line"] for r in out] == ["a", "$1", "x"]


def test_tidy_ascii_text_meets_plain_searches_only(spark, sf_dir):
    """Scattered classes of characters cost more than half of the canonical form of texts that need no tidying."""
    plan = QUERIES["text_normalize"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "Contains(" in plan
    assert "\\x0B\\x0C\\x1C-\\x1F" not in plan and "[^\\x00-\\x7F]" not in plan and "[ABD-KM-QT-Z]" not in plan


def test_every_untidy_mark_is_tidied(spark):
    """Each break and blank between, before and after letters gives what the longer patterns give."""
    marks = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " ", " ", " ", "é"]
    texts = [f"{a}x{a}{b}y{b}" for a in marks for b in marks] + [f"x{a}y" for a in marks]
    blank, breaks = " \t\x1f ", "\n\r\x0b\x0c\x1c-\x1e\x85  "

    def expected(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()
        lines = re.sub(f"[{blank}]*[{breaks}][{blank}{breaks}]*", "\n", plain)
        spaced = re.sub("[ \t]{2,}|\t", " ", lines).strip(" \t\x1f \n")
        return re.sub(r"([ABD-KM-QT-Z])\1+", r"\1", re.sub(r"([LRSC])\1{2,}", r"\1", spaced))

    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", normalize_text(F.col("text")).alias("norm"))
    assert [(r.text, r.norm) for r in rows.collect() if r.norm != expected(r.text)] == []
