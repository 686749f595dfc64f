"""Printed layouts through the whole extraction."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.operators import rules as R
from ledgerloom.operators.extract import canonical, extract, extraction_report, matches_in_context

IRRIGATION = """Turno de riego, segundo semestre
Total a pagar: $ 9,405.40
Fecha límite de pago
21-Abr-2026
Impuestos IVA 1,205.40; fondo de canales 12.00
Referencia de pago 4400552211
Período de facturación: 03-Mar-2026 hasta 02-Abr-2026
Acequia Mayor de Usuarios S.A.
Nit 811.222.333-4
"""
NOISY = (
    "Emisor:  Faro   Verde S.A.S\nNiit: 905123987\nFaactura  Electrónica\tde Venta No. ZB2210\n"
    "Fecha  de EMISIÓN:\t05/02/2026\nMonto IVA: COP 0,00\nSubtotal: COP 45.500,00\nTootal a Pagar: COP   45.500,00\n"
)
PRUNING = """Poda y tala para conjuntos residenciales
Total: 418.250,75
Visita realizada 06/08/2026
Generado por Tinta Rápida, NIT 860.001.002-9
Numeración para factura electrónica de venta No. 31004455
HK - 4417
Jardines Altamira
NIT 71888999-2
"""
THEATRE = """Iva (5%): 1.900
Subtotal 38.001
Total: 39.900
Noche de estreno 17/10/2025
Sala Oriente - Telones del Puerto LTDA - NIT 890777123-8
Factura Electrónica de Venta:
TP6604
"""
BOOKBINDER = """Fecha de Pago
Fecha de Expedición
14/05/2026 09:15
1
Cuero repujado
2.00
1.500,00
0,00
3.000,00
Total Valor: 3,000.00
Factura Electrónica de Venta
No.EN2200456
Encuadernación Central - Lomo y Cosido S.A.S. - Nit. 904222333-3
"""
NO_ID = ("Factura Electrónica De Venta No. Q-515\nEmisor: Orilla Norte S.A.S\nFecha de Emisión: 19/11/2025\n"
         "Total a Pagar: COP 88,450.30\n")
PARTIAL = "Factura Electrónica de Venta JK5501\nFecha de Emisión: 22/10/2025\nTotal: $73.100\nIVA 11.671\n"
NOTHING = "hello world, this is no bill"
SHORT_ID = "Factura Electrónica de Venta No. FE900\nEmisor: Orilla Norte S.A.S\nNIT 12\nFecha de Emisión: 19/11/2025\nTotal: 10\n"
PERCENT = NO_ID + "IVA 19%\n"
BAD_CELL = NO_ID + "1\nCosa buena\n2.00\n1.2.3\n0,00\n3.000,00\n"
TEXTS = {n: globals()[n] for n in (
    "IRRIGATION", "NOISY", "PRUNING", "THEATRE", "BOOKBINDER", "NO_ID", "PARTIAL", "NOTHING", "SHORT_ID",
    "PERCENT", "BAD_CELL")}


@pytest.fixture(scope="module")
def found(rows):
    out = rows(list(TEXTS.items()), "doc_id string, text string", extract)
    return {r["doc_id"]: r for r in out}


@pytest.mark.parametrize(("doc", "number", "name", "tax_id", "issue", "due", "total"), [
    ("IRRIGATION", "4400552211", "ACEQUIA MAYOR DE USUARIOS S.A.", "811.222.333-4", date(2026, 3, 3), date(2026, 4, 21), "9405.40"),
    ("NOISY", "ZB2210", "FARO VERDE S.A.S", "905123987", date(2026, 2, 5), None, "45500.00"),
    ("PRUNING", "HK-4417", "JARDINES ALTAMIRA", "71888999-2", date(2026, 8, 6), None, "418250.75"),
    ("THEATRE", "TP6604", "TELONES DEL PUERTO LTDA", "890777123-8", date(2025, 10, 17), None, "39900.00"),
    ("BOOKBINDER", "EN2200456", "LOMO Y COSIDO S.A.S", "904222333-3", date(2026, 5, 14), date(2026, 5, 14), "3000.00"),
    ("NO_ID", "Q-515", "ORILLA NORTE S.A.S", "SIN-NIT-ORILLA", date(2025, 11, 19), None, "88450.30"),
])
def test_layouts(found, doc, number, name, tax_id, issue, due, total):
    r = found[doc]
    assert (r["number"], r["supplier"]["name"], r["supplier"]["tax_id"]) == (number, name, tax_id)
    assert (r["issue_date"], r["due_date"], r["total"]) == (issue, due, Decimal(total))
    assert r["route"] == "FULL" and sum(i["total"] for i in r["items"]) in (r["subtotal"], Decimal("3000"))


def test_amount_details(found):
    assert found["IRRIGATION"]["tax"] == Decimal("1205.40")
    assert found["IRRIGATION"]["subtotal"] == Decimal("8200.00") and found["IRRIGATION"]["subtotal_derived"]
    # One unit off: the printed subtotal gives way to total - tax.
    assert found["THEATRE"]["subtotal"] == Decimal("38000.00")
    # A percentage without an amount is still taken for the tax.
    assert found["PERCENT"]["tax"] == Decimal("19.00")
    assert found["BOOKBINDER"]["items"][0]["description"] == "CUERO REPUJADO"


def test_routes(found):
    assert found["PARTIAL"]["route"] == "PARTIAL" and found["PARTIAL"]["missing_fields"] == ["supplier"]
    assert found["NOTHING"]["route"] == "NONE"
    assert found["NOTHING"]["message"] == (
        "No se encontró el número de factura; No se encontró la entidad (proveedor); "
        "No se encontró la fecha de emisión; No se encontró el total. "
        "Revise los patrones del extractor o use otro formato.")
    assert found["SHORT_ID"]["route"] == "ERROR"
    assert found["BAD_CELL"]["route"] == "ERROR"


def test_report(spark):
    df = spark.createDataFrame([("a", NOTHING), ("b", BOOKBINDER)], "doc_id string, text string")
    got = {(r.doc_id, r.field): (r.status, r.pattern) for r in extraction_report(extract(df)).collect()}
    assert got["a", "number"] == ("no_encontrado", "-")
    assert got["a", "tax"] == ("por_defecto", "-")
    assert ("a", "supplier_tax_id") not in got
    assert got["b", "issue_date"] == ("ok", "fecha_de_expedicion_linea_siguiente")
    assert got["b", "items"] == ("ok", "fila_estructurada")


def test_authorization_context(spark):
    rule = R.rules_for(R.DEFAULT_RULES, "number")[1]
    text = ("Resolución factura electrónica de venta No. 330021\nx\n" + "y" * 70
            + "\nFactura electrónica de venta No. FE22")
    df = canonical(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    (row,) = df.select(matches_in_context(df.norm, rule).alias("m")).collect()
    assert [(m.value, m.excluded) for m in row.m] == [("330021", True), ("FE22", False)]


@pytest.fixture(scope="module")
def stored_rules(spark, tmp_path_factory):
    """A stored table with rules of the user's own beside the given ones."""
    at = str(tmp_path_factory.mktemp("rules") / "table")
    own = [
        R.Rule("number", 0, "orden", r"(?Ud)ORDEN\s+(\d+)"),
        R.Rule("items", 2, "fila_con_barras", r"(?Umd)^\s*([A-Z][^\n|]{2,90})\|(\d+)\|([\d.,]+)\|([\d.,]+)\|([\d.,]+)\s*$", 5),
        R.Rule("issue_date", 9, "dia_de_corte", r"DIA\s+DE\s+CORTE"),
        R.Rule("total", 9, "importe", r"(?Ud)IMPORTE\s*:?\s*([\d][\d.,]*)"),
    ]
    R.rule_table(spark).union(R.rule_table(spark, own)).write.parquet(at)
    return spark.read.parquet(at)


OWN = """Orden 4711
Emisor: Orilla Norte S.A.S
Día de corte
19/11/2025
Clavo|3|10,00|0,00|30,00
Remache|1|5,00|0,95|5,00
Importe 35,95
"""


def test_stored_rules_of_the_user(spark, stored_rules, monkeypatch):
    """Rules of a table need no collect: they are read when the job runs, and the report names them."""
    df = spark.createDataFrame([("a", OWN), ("b", "Orden 4711\n" + NO_ID)], "doc_id string, text string")
    monkeypatch.setattr(type(df), "collect", lambda self: pytest.fail("collected"))
    rows = extract(df, stored_rules)
    report = extraction_report(rows)
    monkeypatch.undo()
    got = {r.doc_id: r for r in rows.collect()}
    assert got["b"]["number"] == "4711" and got["b"]["total"] == Decimal("88450.30")
    assert [(i["description"], i["total"]) for i in got["a"]["items"]] == [("CLAVO", Decimal("30.00")), ("REMACHE", Decimal("5.00"))]
    named = {(r.doc_id, r.field): r.pattern for r in report.collect()}
    assert named["a", "number"] == "orden" and named["a", "items"] == "fila_con_barras" and named["a", "total"] == "importe"
    assert named["a", "issue_date"] == "dia_de_corte_linea_siguiente"


def test_stored_rules_give_what_the_programs_rules_give(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    own, stored = (extract(df, r).drop("_rules") for r in (R.DEFAULT_RULES, R.rule_table(spark)))
    assert own.columns == stored.columns
    assert sorted(map(str, own.collect())) == sorted(map(str, stored.collect()))


def test_stored_rules_join_nothing_and_their_number_is_checked(spark, stored_rules, monkeypatch):
    df = spark.createDataFrame([("a", OWN)], "doc_id string, text string")
    plan = extract(df, stored_rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan
    monkeypatch.setattr(R, "MOST_RULES", 3)
    with pytest.raises(Exception, match="more than 3 rules"):
        extract(df, stored_rules).collect()


def test_rules_loaded_into_the_program(spark, stored_rules):
    df = spark.createDataFrame([(1, "Orden 4711\n" + NO_ID)], "doc_id int, text string")
    (row,) = extract(df, R.load_rules(stored_rules)).select("number", "number_pattern").collect()
    assert tuple(row) == ("4711", "orden")


def test_windows_can_be_widened(spark):
    """Beyond five lines and sixty characters only if asked for."""
    far = "\n".join(["Nombre Largo Plazo", *["12"] * 7, "NIT 904222333-3", "Fecha de Emisión", *["-"] * 7, "05/06/2026"])
    wording = "Resolución " + "x" * 25 + " factura electrónica de venta No. 330021\n"
    df = spark.createDataFrame([(1, far), (2, wording)], "doc_id int, text string")
    near = {r.doc_id: r for r in extract(df).collect()}
    wide = {r.doc_id: r for r in extract(df, windows=R.Windows(None, None, None)).collect()}
    assert near[1].supplier is None and wide[1].supplier.name == "NOMBRE LARGO PLAZO"
    assert near[1].issue_date_pattern == "primera_fecha_del_documento"
    assert wide[1].issue_date_pattern == "fecha_de_emision_linea_siguiente"
    assert near[2].number is None and wide[2].number is None


def test_internal_marks_in_text(spark):
    df = spark.createDataFrame([(1, NO_ID.replace("Orilla", "Or\x01il\x02la"))], "doc_id int, text string")
    (row,) = extract(df).select("number", "total").collect()
    assert tuple(row) == ("Q-515", Decimal("88450.30"))


def test_filter_on_result_stays_small(spark):
    """A later filter must not copy the extraction expressions."""
    df = spark.createDataFrame([(1, NO_ID)], "doc_id int, text string")
    plan = extract(df).filter("route = 'FULL' AND total > 5").select("doc_id", "number")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("REFERENCIA") <= 4
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
