"""The ordered extraction rules, as a small table that users can extend.

``regex`` is matched against canonical text (see ``functions.text``). The
``(?U)`` flag gives Unicode classes, ``m`` line anchors, ``d`` newline-only
line ends. For the date fields it is a label fragment, from which the inline
and the stand-alone matcher are built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_DDL = "field string, rank int, name string, regex string, groups int"
#: Rules of a stored table travel with every task, so their number is checked.
MOST_RULES = 10_000
#: Stands between the captures of a match.
SEP = "\x02"


@dataclass(frozen=True)
class Rule:
    field: str
    rank: int
    name: str
    regex: str
    groups: int = 1


# ---------------------------------------------------------------- fixed values
# Patterns, names and word lists below must equal the source system's for the
# results to agree.
_MONEY = r"(?:COP|USD|EUR|\$)?\s*-?\s*([\d][\d.,]*)"

DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("number", 1, "referencia_de_pago",
         r"(?Ud)REFERENCIA\s+DE\s+PAGO\s*:?\s*\n?\s*(\d{5,25})"),
    Rule("number", 2, "factura_electronica_venta_no",
         r"(?Ud)FACTURA\s+ELECTRONICA\s+(?:DE\s+)?VENTA\s*[:\n]*\s*"
         r"(?:NO\.?|N[°º])?\s*\.?\s*([A-Z]{0,6}-?\d{2,}[\w-]*)"),
    Rule("number", 3, "generico_factura_no",
         r"(?Ud)(?:FACTURA|INVOICE)\b[^\n]{0,80}?NO\.?\s*[:.]?\s*([A-Z]{0,6}-?\d{3,})"),
    Rule("number", 4, "numero_prefijo_guion_linea",
         r"(?Umd)^\s*([A-Z]{1,5})\s*-\s*(\d{3,10})\s*$", 2),
    Rule("number", 5, "numero_solo_prefijo_no",
         r"(?Umd)^\s*NO\.?\s*[:.]?\s*(\d{3,10})\s*$"),
    Rule("issue_date", 1, "fecha_de_emision", r"FECHAS?\s+DE\s+EMISION"),
    Rule("issue_date", 2, "fecha_de_expedicion", r"FECHA\s+DE\s+EXPEDICION"),
    Rule("issue_date", 3, "fecha_de_validacion", r"FECHAS?\s+DE\s+VALIDACION"),
    Rule("issue_date", 4, "periodo_de_facturacion", r"PERIODO\s+DE\s+FACTURACION"),
    Rule("issue_date", 5, "fecha_de_factura", r"FECHAS?\s+DE\s+FACTURA"),
    Rule("issue_date", 6, "fecha_de_generacion", r"FECHAS?\s+DE\s+GENERACION"),
    Rule("due_date", 1, "fecha_limite_de_pago", r"FECHA\s+LIMITE\s+DE\s+PAGO"),
    Rule("due_date", 2, "fecha_de_vencimiento", r"FECHAS?\s+DE\s+VENCIMIENTO"),
    Rule("due_date", 3, "fecha_de_pago", r"FECHA\s+DE\s+PAGO"),
    Rule("total", 1, "total_a_pagar", rf"(?Ud)TOTAL(?:ES)?\s+A\s+PAGAR\s*:?\s*{_MONEY}"),
    Rule("total", 2, "total_venta", rf"(?Ud)TOTAL\s+VENTA\s*:?\s*{_MONEY}"),
    Rule("total", 3, "total_valor", rf"(?Umd)^\s*TOTAL\s+VALOR\s*:?\s*{_MONEY}"),
    Rule("total", 4, "total_simple", rf"(?Ud)(?<!\w)TOTAL\s*:?\s*{_MONEY}"),
    Rule("subtotal", 1, "subtotal", rf"(?Ud)SUBTOTAL\s*:?\s*{_MONEY}"),
    Rule("tax", 1, "monto_iva", rf"(?Ud)MONTO\s+IVA\s*:?\s*{_MONEY}"),
    Rule("tax", 2, "impuestos_iva_inline", rf"(?Ud)IMPUESTOS\s+IVA\s*:?\s*{_MONEY}"),
    Rule("tax", 3, "iva_etiqueta",
         rf"(?Ud)\bIVA\b\s*(?:\([^)]*\))?\s*:?\s*(?![\d.,]+\s*%){_MONEY}"),
    Rule("items", 1, "fila_estructurada",
         r"(?Umd)^\s*\d{1,4}\s*\n([A-Z][^\n]{2,90})\n(\d+\.\d{1,3})\n([\d.,]+)\n([\d.,]+)\n([\d.,]+)\s*$",
         5),
)

AUTHORIZATION_WORDS = r"AUTORIZACI|RESOLUCI|NUMERACI|HABILITA"
AUTHORIZATION_BEFORE = (
    r"(?Ud)\b(?:AUTORIZACI\w*|RESOLUCI\w*|NUMERACI\w*|HABILITA)\b[^:\n]{0,40}$"
)

_TAX_NUMBER = r"([\d]{1,12}(?:[.\-][\d]{1,6}){0,3}(?:-[\d]{1,2})?)"
TAX_ID = rf"(?Ud)N\.?I\.?T\.?\s*(?:DEL\s+EMISOR\s*)?[:.\-\s]*{_TAX_NUMBER}"
TAX_ID_LINE = rf"(?Ud)^(.*?)\bN\.?I\.?T\.?\s*(?:DEL\s+EMISOR\s*)?[:.\-\s]*{_TAX_NUMBER}\s*$"
TAX_ID_SUFFIX = r"(?Ud)\s*-\s*N\.?I\.?T\.?\.?\s*[\d.\-]+\s*$"
ISSUER = r"(?Ud)EMISOR\s*:\s*([^\n]{2,120})"
COMPANY = (
    r"(?Ud)^([A-Z][\w.,&\- ]{1,80}?(?:S\.?\s?A\.?(?:\s?S\.?)?|LTDA\.?|LTD\.?|INC\.?|SAS))\.?,?\s*$"
)
# Each pattern's matches hold one of the words; looking for those first is cheaper.
COMPANY_WORDS, COMPANY_SA = "LTD|INC", r"(?U)S\.?\s?A"
PLATFORM_WORDS = "PLATAFORMA|ELABORAD|GENERAD|PROVEEDOR|SOFTWARE|POWERED"
CURRENCY_WORDS = "COP|USD|EUR|GBP"
PLATFORM = (
    r"(?Ud)PLATAFORMA\s*:|ELABORAD[OA]S?\s+EN|GENERAD[OA]S?\s+(?:EN|POR)|"
    r"PROVEEDOR\s+TECNOLOGICO|SOFTWARE\s*:|POWERED\s+BY"
)
NOT_A_NAME_START = r"^(?:TEL|CEL|EMAIL|WWW\.|HTTP|DIR)"
NOT_A_NAME = r"(?Ud)^[\d\s.,:/-]+$"
CONTEXT_CHARS, LINES_ABOVE, LINES_BELOW_LABEL = 60, 5, 5

CURRENCY = r"(?U)\b(COP|USD|EUR|GBP)\b"
REGIONAL_MARKERS = r"NIT|DIAN|COP|BOGOT|MEDELL|CUFE"

REQUIRED_FIELDS = ("number", "supplier", "issue_date", "total")
FIELD_LABELS = {
    "number": "el número de factura",
    "supplier": "la entidad (proveedor)",
    "issue_date": "la fecha de emisión",
    "total": "el total",
}
OK, NOT_FOUND, DEFAULTED, DERIVED = "ok", "no_encontrado", "por_defecto", "derivado"
DERIVED_SUBTOTAL = "calculado_como_total_menos_impuesto"
NEXT_LINE_SUFFIX = "_linea_siguiente"
TAX_ID_NAME = "nit_generico"
ISSUER_NAME = "etiqueta_emisor"
COMPANY_NAME = "primera_linea_empresa"
NEAR_TAX_ID_NAME = "nit_con_nombre_cercano"
ANY_DATE_NAME = "primera_fecha_del_documento"
NO_TAX_ID_PREFIX = "SIN-NIT-"
AGGREGATE_LINE = "Conceptos facturados (agregado del documento)"
MESSAGE_NONE = ". Revise los patrones del extractor o use otro formato."
MESSAGE_PARTIAL = ". Campos recuperables entregados para fusión híbrida."
MESSAGE_NO_ITEMS = "No se encontró las líneas de la factura"
# ------------------------------------------------------------ end fixed values


def rule_table(spark: SparkSession, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """The rules as a DataFrame, ready to be edited, stored or unioned with more."""
    return spark.createDataFrame([astuple(r) for r in rules], RULE_DDL)


def load_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table as part of the program: their patterns become constants of the plan."""
    rows = table.select("field", "rank", "name", "regex", "groups").collect()
    return tuple(sorted((Rule(*r) for r in rows), key=lambda r: (r.field, r.rank)))


def rules_for(rules: Iterable[Rule], field: str) -> list[Rule]:
    return sorted((r for r in rules if r.field == field), key=lambda r: r.rank)


# ------------------------------------------------------------- rules in a plan
@dataclass(frozen=True)
class Windows:
    """How far around a match the rules look; None is without end.

    The defaults are the system's that this one follows.
    """

    context_chars: int | None = CONTEXT_CHARS
    lines_above: int | None = LINES_ABOVE
    lines_below: int | None = LINES_BELOW_LABEL


@dataclass(frozen=True)
class Ref:
    """One rule inside an expression: its parts are columns."""

    name: Column
    regex: Column
    groups: Column
    literal: Column
    captures: Column

    def within(self, text: Column, value: Column) -> Column:
        """``value``, which is NULL without a match, worked out only where the text holds the rule's letters."""
        return F.when(F.contains(text, self.literal), value)


def ref(rule: Rule) -> Ref:
    # Written out here: a loop in the plan is no constant and would run for every row.
    captures = SEP.join(f"${g}" for g in range(1, rule.groups + 1))
    return Ref(F.lit(rule.name), F.lit(rule.regex), F.lit(rule.groups), literal_of(F.lit(rule.regex)), F.lit(captures))


def _stored_ref(row: Column) -> Ref:
    captures = F.array_join(F.transform(F.sequence(F.lit(1), row["groups"]), lambda g: F.concat(F.lit("$"), g.cast("string"))), SEP)
    return Ref(row["name"], row["regex"], row["groups"], row["literal"], captures)


@dataclass(frozen=True)
class Known:
    """Rules of the program: every pattern is a constant."""

    rules: tuple[Rule, ...]

    def _refs(self, *fields: str) -> list[Ref]:
        return [ref(r) for f in fields for r in rules_for(self.rules, f)]

    def attach(self, docs: DataFrame) -> DataFrame:
        return docs

    def each(self, take: Callable[[Ref], Column], *fields: str) -> Column:
        """What every rule of the fields gives, in their order."""
        return F.array(*[take(r) for r in self._refs(*fields)])

    def first(self, take: Callable[[Ref], Column], kind: str, field: str) -> Column:
        """What the first rule gives that gives anything; later ones are not tried."""
        return F.coalesce(F.lit(None).cast(kind), *[take(r).cast(kind) for r in self._refs(field)])


@dataclass(frozen=True)
class Stored:
    """Rules of a table: a column of all its rows, read when the job runs and sent along with its tasks."""

    column: str = "_rules"
    table: DataFrame | None = None

    def attach(self, docs: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(c.split()[0]) for c in RULE_DDL.split(", ")], literal_of(F.col("regex")).alias("literal"))
        many = F.raise_error(F.lit(f"more than {MOST_RULES} rules"))
        rows = self.table.agg(
            F.when(F.count("*") <= MOST_RULES, F.array_sort(F.collect_list(row))).otherwise(many).alias("rules")
        )
        return docs.withColumn(self.column, rows.scalar())

    def _own(self, field: str) -> Column:
        return F.filter(F.col(self.column), lambda r: r["field"] == field)

    def each(self, take: Callable[[Ref], Column], *fields: str) -> Column:
        parts = [F.transform(self._own(f), lambda r: take(_stored_ref(r))) for f in fields]
        return F.concat(*parts)

    def first(self, take: Callable[[Ref], Column], kind: str, field: str) -> Column:
        return F.aggregate(
            self._own(field), F.lit(None).cast(kind),
            lambda found, r: F.coalesce(found, take(_stored_ref(r)).cast(kind)),
        )


def in_plan(rules: Iterable[Rule] | DataFrame | Known | Stored) -> Known | Stored:
    """Rules of the program, or a table of rules, ready for use in expressions."""
    if isinstance(rules, (Known, Stored)):
        return rules
    return Stored(table=rules) if isinstance(rules, DataFrame) else Known(tuple(rules))


def inline_label(fragment: Column) -> Column:
    """``label: value`` on a line; the value may start on the next line."""
    return F.concat(F.lit(r"(?Umd)^\s*"), fragment, F.lit(r"\s*:\s*([^\n]+)$"))


def standalone_label(fragment: Column) -> Column:
    """A line holding nothing but the label, or one of several joined by bars."""
    return F.concat(F.lit(r"(?Umd)^\s*(?:"), fragment, F.lit(r")\s*:?\s*$"))


#: Runs of this many letters or more count as equally long.
LONGEST = 10


def literal_of(regex: Column) -> Column:
    """Letters that every match of a pattern holds; empty where that is not plain to see.

    Classes, groups, escapes and optional letters are cut out; every run of letters that is left is certain, and the
    longest tells most, the last of several: labels begin alike. Alternatives outside groups, unusual escapes and flags,
    and nested classes give the empty string.
    """
    plain = F.regexp_replace(regex, r"\\[^A-Za-z0-9]|\\[sSdDwWbBtnrf]", " ")
    plain = F.regexp_replace(plain, r"\[\^?[^\[\]^]+\]", " ")
    for _ in range(4):
        plain = F.regexp_replace(plain, r"\([^()]*\)", " ")
    plain = F.regexp_replace(plain, r"[A-Z](?=[?*{])", " ")
    unclear = plain.rlike(r"[\[\]()|\\]") | regex.rlike(r"\(\?[A-Za-z]*[ix]")
    # Step by step and not by a loop over the runs, so that it stays a constant of the plan where the pattern is one.
    longest = F.lit("")
    for n in range(3, LONGEST + 1):
        longest = F.when(plain.rlike(f"[A-Z]{{{n},}}"), F.regexp_extract(plain, f"(?s)^.*(?<![A-Z])([A-Z]{{{n},}})", 1)).otherwise(longest)
    return F.when(unclear, F.lit("")).otherwise(longest)


def match_regex(field: Column, regex: Column) -> Column:
    """What a rule looks for on its own (labels: either of their two forms)."""
    label = F.concat(F.lit(r"(?Umd)^\s*"), regex, F.lit(r"\s*(?::\s*[^\n]+|:?\s*)$"))
    return F.when(field.isin("issue_date", "due_date"), label).otherwise(regex)


def rule_hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Documents each rule of a table matches anywhere, before ranking: (field, rank, name, documents).

    ``docs`` needs a ``norm`` column. Matches are counted per rule before the shuffle, so no row per
    document and rule ever travels; a rule without matches has 0.
    """
    key = ["field", "rank", "name"]
    held = in_plan(table).attach(docs.select("norm"))
    matched = F.filter("_rules", lambda r: F.contains("norm", r["literal"]) & F.rlike("norm", match_regex(r["field"], r["regex"])))
    hits = held.select(F.inline(F.transform(matched, lambda r: F.struct(*[r[k].alias(k) for k in key]))))
    counts = hits.groupBy(*key).agg(F.count("*").alias("documents"))
    return table.select(*key).join(counts, key, "left").select(*key, F.coalesce("documents", F.lit(0)).alias("documents"))
