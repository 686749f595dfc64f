"""Rule extraction over whole document tables.

Every field is found inside its own row with built-in expressions: all matches
of a rule become an array, unsuitable ones are filtered, the first survivor of
the first successful rule wins. Nothing is exploded, ranked or shuffled, so the
job stays map-only whatever the number or skew of the documents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import latam_amount
from ledgerloom.functions.binding import built_once, first_of, found, let, settle
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.text import lines_of, mentions, normalized
from ledgerloom.operators import rules as R
from ledgerloom.operators.rules import DEFAULT_RULES, Known, Ref, Rule, Stored, Windows, in_plan
from ledgerloom.schemas import AMOUNT

# Marks put in front of, between and behind captures while matching.
_AT, _SEP, _END = "\x01", R.SEP, "\x03"
_TEXT_HIT, _DATE_HIT = "struct<value:string,pattern:string>", "struct<value:date,pattern:string>"
_AMOUNT_HIT = f"struct<value:{AMOUNT.simpleString()},pattern:string>"
_ITEM = "struct<description:string," + ",".join(f"{f}:{AMOUNT.simpleString()}" for f in ("quantity", "unit_price", "tax", "total")) + ">"
_ITEMS_HIT = f"struct<value:array<{_ITEM}>,pattern:string>"


def canonical(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``norm`` and ``lines``; the three internal mark characters are moved away."""
    norm = F.col("norm")
    return (
        docs.withColumn("norm", normalized(text))
        .withColumn(
            "norm",
            F.when(norm.rlike("[\\x01-\\x03]"), F.translate(norm, _AT + _SEP + _END, "\x04\x05\x06"))
            .otherwise(norm),
        )
        .withColumn("lines", lines_of(norm))
    )


# ------------------------------------------------------------------- matching
def _marked(text: Column, rule: Ref) -> Column:
    """Pieces of the text, each later one starting with the captures of a match."""
    return F.split(F.regexp_replace(text, rule.regex, F.concat(F.lit(_AT), rule.captures, F.lit(_END + "$0"))), _AT)


def match_groups(text: Column, rule: Ref) -> Column:
    """Captures of every non-overlapping match: array<array<string>>."""

    def pick(pieces: Column) -> Column:
        later = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.transform(later, lambda p: F.split(F.split_part(p, F.lit(_END), F.lit(1)), _SEP))

    return let(_marked(text, rule), pick)


def _walk_matches(pieces: Column, start: Column, take, windows: Windows) -> Column:
    """Fold over the matches with the text just before each of them.

    Carries the last characters along, so the cost stays linear in the text.
    """

    def last(text: Column) -> Column:
        return text if windows.context_chars is None else F.right(text, F.lit(windows.context_chars))

    def step(acc: Column, piece: Column) -> Column:
        excluded = acc["before"].rlike(R.AUTHORIZATION_BEFORE)
        value = F.translate(F.split_part(piece, F.lit(_END), F.lit(1)), _SEP, "-")
        body = F.split_part(piece, F.lit(_END), F.lit(-1))
        return F.struct(last(F.concat(acc["before"], body)).alias("before"), take(acc["out"], value, excluded).alias("out"))

    head = last(F.get(pieces, F.lit(0)))
    later = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.aggregate(later, F.struct(head.alias("before"), start.alias("out")), step, lambda acc: acc["out"])


def _first_allowed(pieces: Column, windows: Windows) -> Column:
    return _walk_matches(
        pieces, F.lit(None).cast("string"),
        lambda out, value, excluded: F.coalesce(out, F.when(~excluded, value)), windows,
    )


def _first_match(text: Column, rule: Ref) -> Column:
    """First match; several captures are joined by a dash."""
    groups = F.transform(F.sequence(F.lit(1), rule.groups), lambda g: found(text, rule.regex, g))
    return F.when(rule.groups == 1, found(text, rule.regex)).otherwise(
        let(groups, lambda parts: F.when(F.get(parts, F.lit(0)).isNotNull(), F.array_join(parts, "-")))
    )


def matches_in_context(text: Column, rule: Rule, windows: Windows = Windows()) -> Column:
    """Every match with its value and whether authorisation wording excludes it."""
    empty = F.array().cast("array<struct<value:string,excluded:boolean>>")
    return let(_marked(text, R.ref(rule)), lambda pieces: _walk_matches(
        pieces, empty,
        lambda out, value, excluded: F.concat(
            out, F.array(F.struct(value.alias("value"), excluded.alias("excluded")))), windows,
    ))


def _hit(value: Column, pattern: Column) -> Column:
    """struct(value, pattern), NULL without a value."""
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), pattern.alias("pattern"))))


# --------------------------------------------------------------------- fields
def number_hit(text: Column, rules: Known | Stored, windows: Windows = Windows()) -> Column:
    """First match of the first rule that matches outside authorisation wording; later rules are not tried."""
    plain = rules.first(lambda r: r.within(text, _hit(F.trim(_first_match(text, r)), r.name)), _TEXT_HIT, "number")
    walked = rules.first(
        lambda r: r.within(text, _hit(F.trim(let(_marked(text, r), lambda p: _first_allowed(p, windows))), r.name)),
        _TEXT_HIT, "number",
    )
    # The walk is needed only where such wording occurs at all.
    return F.when(~mentions(text, R.AUTHORIZATION_WORDS), plain).otherwise(walked)


def amount_hit(text: Column, rules: Known | Stored, field: str) -> Column:
    """First rule whose first match is an amount; later rules are not tried."""
    return rules.first(lambda r: r.within(text, _hit(latam_amount(found(text, r.regex)), r.name)), _AMOUNT_HIT, field)


def date_hit(text: Column, lines: Column, rules: Known | Stored, field: str, windows: Windows = Windows()) -> Column:
    """The labelled date: struct(value, pattern).

    ``label: value`` in rule order, else for each line that is nothing but a
    label the lines just below it which are not labels themselves.
    """

    def bars(fragments: Column) -> Column:
        return R.standalone_label(F.array_join(fragments, "|"))

    all_labels = bars(rules.each(lambda r: r.regex, "issue_date", "due_date"))
    own_labels = bars(rules.each(lambda r: r.regex, field))

    def first_date(raws: Column) -> Column:
        return first_of(F.transform(raws, parse_date))

    inline = rules.first(
        lambda r: r.within(text, _hit(first_date(F.regexp_extract_all(text, R.inline_label(r.regex), F.lit(1))), r.name)),
        _DATE_HIT, field,
    )

    def label_name(line: Column) -> Column:
        named = rules.first(lambda r: F.when(F.rlike(line, R.standalone_label(r.regex)), r.name), "string", field)
        return F.concat(named, F.lit(R.NEXT_LINE_SUFFIX))

    def below(line: Column, at: Column) -> Column:
        size = F.size(lines) if windows.lines_below is None else F.lit(windows.lines_below)
        usable = F.filter(F.slice(lines, at + 2, size), lambda x: ~F.rlike(x, all_labels))
        return F.when(F.rlike(line, own_labels), _hit(first_date(usable), label_name(line)))

    labelled = F.exists(rules.each(lambda r: F.contains(text, r.literal), field), lambda held: held) & F.rlike(text, own_labels)
    return F.coalesce(inline, F.when(labelled, first_of(F.transform(lines, below))))


def any_date_hit(text: Column, chars: int | None = None) -> Column:
    """First date of the whole text, or of its first ``chars`` characters."""
    head = text if chars is None else F.left(text, F.lit(chars))
    return _hit(parse_date(head), F.lit(R.ANY_DATE_NAME))


def _is_platform(line: Column) -> Column:
    return mentions(line, R.PLATFORM_WORDS) & line.rlike(R.PLATFORM)


def _company_segment(text: Column, marks: str) -> Column:
    """The dash-separated part that carries a legal suffix, if any."""
    parts = F.transform(F.split(text, "-"), lambda s: F.btrim(s, F.lit(marks)))
    return F.when(text.contains("-"), first_of(parts, lambda s: s.rlike(R.COMPANY)))


def _company_on_line(line: Column) -> Column:
    cleaned = F.regexp_replace(line, R.TAX_ID_SUFFIX, "")
    return let(cleaned, lambda c: let(
        F.coalesce(_company_segment(c, " .,-"), c),
        lambda s: F.rtrim(F.trim(found(s, R.COMPANY)), F.lit(",")),
    ))


def _name_before_tax_id(prefix: Column) -> Column:
    def read(cleaned: Column) -> Column:
        name = F.rtrim(F.coalesce(_company_segment(cleaned, " "), cleaned), F.lit(","))
        return F.when(F.length(cleaned) >= 3, F.nullif(name, F.lit("")))

    return let(F.trim(F.btrim(F.trim(prefix), F.lit("-:., "))), read)


def _name_above(lines: Column, at: Column, windows: Windows) -> Column:
    first = F.lit(0) if windows.lines_above is None else F.greatest(at - windows.lines_above, F.lit(0))
    above = F.reverse(F.slice(lines, first + 1, at - first))

    def plausible(line: Column) -> Column:
        return (
            F.length(line).between(4, 90)
            & ~_is_platform(line)
            & ~line.rlike(R.TAX_ID_LINE)
            & ~line.rlike(R.NOT_A_NAME_START)
            & ~line.rlike(R.NOT_A_NAME)
        )

    return F.rtrim(first_of(above, plausible), F.lit(",;- "))


def _named_tax_id(lines: Column, windows: Windows) -> Column:
    """First tax-id line (not of a billing platform) with a name on it or above it."""

    def at_line(line: Column, at: Column) -> Column:
        name = F.coalesce(
            _name_before_tax_id(F.regexp_extract(line, R.TAX_ID_LINE, 1)), _name_above(lines, at, windows)
        )
        return F.when(
            line.rlike(R.TAX_ID_LINE) & ~_is_platform(line),
            F.struct(name.alias("name"), found(line, R.TAX_ID_LINE, 2).alias("tax_id")),
        )

    return first_of(F.transform(lines, at_line), lambda h: h["name"].isNotNull())


@built_once
def _issuer() -> Column:
    return F.trim(found(F.col("norm"), R.ISSUER))


@built_once
def _first_company() -> Column:
    likely = F.filter("lines", lambda x: mentions(x, R.COMPANY_WORDS) | x.rlike(R.COMPANY_SA))
    return first_of(F.transform(likely, _company_on_line))


@built_once
def _first_named_tax_id(windows: Windows) -> Column:
    return _named_tax_id(F.col("lines"), windows)


@built_once
def _first_tax_id() -> Column:
    norm, lines = F.col("norm"), F.col("lines")
    own_text = F.when(
        _is_platform(norm), F.array_join(F.filter(lines, lambda x: ~_is_platform(x)), "\n")
    ).otherwise(norm)
    return found(own_text, R.TAX_ID)


def _placeholder_id(name: Column) -> Column:
    letters = F.left(F.regexp_replace(name, "[^A-Z0-9]", ""), F.lit(6))
    return F.concat(F.lit(R.NO_TAX_ID_PREFIX), F.coalesce(F.nullif(letters, F.lit("")), F.lit("UNKNOWN")))


def with_supplier(docs: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """Add ``supplier`` (name, tax_id), ``supplier_pattern`` and ``tax_id_pattern``.

    Issuer label, else company line, else the name next to a tax-id line; each
    is looked for only where the ones before found nothing.
    """
    issuer, company, anchored = F.nullif("_issuer", F.lit("")), F.col("_company"), F.col("_anchored")
    name, printed = F.col("_name"), F.col("_printed_id")
    pattern = (
        F.when(issuer.isNotNull(), F.lit(R.ISSUER_NAME))
        .when(company.isNotNull(), F.lit(R.COMPANY_NAME)).otherwise(F.lit(R.NEAR_TAX_ID_NAME))
    )
    return (
        docs.withColumn("_issuer", _issuer())
        .withColumn("_company", F.when(F.col("_issuer").isNull(), _first_company()))
        .withColumn("_anchored", F.when(F.coalesce(issuer, company).isNull(), _first_named_tax_id(windows)))
        .withColumn("_name", F.coalesce(issuer, company, F.nullif(anchored["name"], F.lit(""))))
        .withColumn("_printed_id", F.when(
            name.isNotNull(), F.coalesce(anchored["tax_id"], _first_tax_id())))
        .withColumns({
            "supplier": F.when(name.isNotNull(), F.struct(
                name.alias("name"), F.coalesce(printed, _placeholder_id(name)).alias("tax_id"))),
            "supplier_pattern": F.when(name.isNotNull(), pattern),
            "tax_id_pattern": F.when(printed.isNotNull(), F.lit(R.TAX_ID_NAME)),
        })
        .drop("_issuer", "_company", "_anchored", "_name", "_printed_id")
    )


def currency_of(text: Column) -> Column:
    """struct(code, confident): printed code, else regional marker, else a guess."""
    return let(
        F.when(mentions(text, R.CURRENCY_WORDS), found(text, R.CURRENCY)),
        lambda code: F.when(
            code.isNotNull(), F.struct(code.alias("code"), F.lit(True).alias("confident"))
        )
        .when(mentions(text, R.REGIONAL_MARKERS),
              F.struct(F.lit("COP").alias("code"), F.lit(True).alias("confident")))
        .otherwise(F.struct(F.lit("USD").alias("code"), F.lit(False).alias("confident"))),
    )


def item_rows(text: Column, rule: Ref) -> Column:
    """Structured six-line item blocks; an unreadable cell stays NULL in its struct."""

    def block(group: Column) -> Column:
        cells = F.transform(F.slice(group, 2, 4), latam_amount)
        return let(cells, lambda n: F.struct(
            F.trim(F.get(group, F.lit(0))).alias("description"),
            *[F.get(n, F.lit(i)).alias(f) for i, f in enumerate(("quantity", "unit_price", "tax", "total"))],
        ))

    return F.transform(match_groups(text, rule), block)


def aggregate_item(subtotal: Column, tax: Column) -> Column:
    """The single line that stands for a document without readable lines."""
    return F.array(F.struct(
        F.lit(R.AGGREGATE_LINE).alias("description"),
        F.lit(1).cast(AMOUNT).alias("quantity"),
        subtotal.cast(AMOUNT).alias("unit_price"),
        tax.cast(AMOUNT).alias("tax"),
        subtotal.cast(AMOUNT).alias("total"),
    ))


def items_hit(text: Column, rules: Known | Stored) -> Column:
    """Item rows of the first rule that finds any: struct(value, pattern)."""

    def own(rule: Ref) -> Column:
        return let(item_rows(text, rule), lambda rows: F.when(
            F.size(rows) > 0, F.struct(rows.alias("value"), rule.name.alias("pattern"))))

    return rules.first(own, _ITEMS_HIT, "items")


# ------------------------------------------------------------------ whole row
@built_once
def _number(rules: Known | Stored, windows: Windows) -> Column:
    return number_hit(F.col("norm"), rules, windows)


@built_once
def _date(rules: Known | Stored, field: str, windows: Windows) -> Column:
    labelled = date_hit(F.col("norm"), F.col("lines"), rules, field, windows)
    return F.coalesce(labelled, any_date_hit(F.col("norm"))) if field == "issue_date" else labelled


@built_once
def _amount(rules: Known | Stored, field: str) -> Column:
    return amount_hit(F.col("norm"), rules, field)


@built_once
def _currency() -> Column:
    return currency_of(F.col("norm"))


@built_once
def _items(rules: Known | Stored) -> Column:
    return items_hit(F.col("norm"), rules)


def _add_hits(docs: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """Each hit as two columns: the value and ``<name>_pattern``."""
    held = docs.withColumns({f"_{name}": hit for name, hit in hits.items()})
    parts = [
        F.col(f"_{name}.{part}").alias(name + suffix)
        for name in hits for part, suffix in (("value", ""), ("pattern", "_pattern"))
    ]
    return held.select("*", *parts).drop(*[f"_{name}" for name in hits])


def add_number(docs: DataFrame, rules: Iterable[Rule] | Known | Stored, windows: Windows = Windows()) -> DataFrame:
    return _add_hits(docs, {"number": _number(in_plan(rules), windows)})


def add_dates(docs: DataFrame, rules: Iterable[Rule] | Known | Stored, windows: Windows = Windows()) -> DataFrame:
    return _add_hits(docs, {f: _date(in_plan(rules), f, windows) for f in ("issue_date", "due_date")})


def add_amounts(docs: DataFrame, rules: Iterable[Rule] | Known | Stored) -> DataFrame:
    """Total, tax (0 by default) and the subtotal reconciled with both."""
    fields = {"total": "total", "tax": "tax", "printed_subtotal": "subtotal"}
    hits = _add_hits(docs, {name: _amount(in_plan(rules), field) for name, field in fields.items()})
    return reconcile_subtotal(hits.withColumn("tax", F.coalesce("tax", F.lit(0).cast(AMOUNT))))


def reconcile_subtotal(rows: DataFrame) -> DataFrame:
    """Replace a missing or inexact subtotal by total - tax when a total is known."""
    total, tax, printed = F.col("total"), F.col("tax"), F.col("printed_subtotal")
    derived = F.col("subtotal_derived")
    derive = total.isNotNull() & (printed.isNull() | (printed + tax != total))
    return (
        rows.withColumn("subtotal_derived", derive).withColumns({
            "subtotal": F.when(derived, (total - tax).cast(AMOUNT)).otherwise(printed),
            "subtotal_pattern": F.when(derived, F.lit(R.DERIVED_SUBTOTAL))
            .otherwise(F.col("printed_subtotal_pattern")),
        })
    )


def add_items(docs: DataFrame, rules: Iterable[Rule] | Known | Stored) -> DataFrame:
    """Printed item rows and the rule that found them, else the aggregate line."""
    none = F.array().cast(f"array<{_ITEM}>")
    subtotal, rows = F.col("subtotal"), F.col("item_rows")
    return (
        docs.withColumn("_items", _items(in_plan(rules)))
        .withColumn("item_rows", F.coalesce("_items.value", none)).withColumn("item_pattern", F.col("_items.pattern"))
        .drop("_items")
        .withColumn("items", F.when(F.size(rows) > 0, rows).when(subtotal > 0, aggregate_item(subtotal, F.col("tax"))).otherwise(none))
    )


def _broken(item: Column) -> Column:
    cells = [item[c] for c in ("quantity", "unit_price", "tax", "total")]
    unreadable = cells[0].isNull()
    for c in cells[1:]:
        unreadable = unreadable | c.isNull()
    return unreadable | (item["total"] <= 0)


def route_extraction(rows: DataFrame) -> DataFrame:
    """Add ``missing_fields``, ``route`` and ``message``.

    FULL, PARTIAL, NONE (no number, supplier or issue date) and NO_ITEMS; a
    document whose values break the contract outright is ERROR.
    """
    c = F.col
    present = {f: c(f).isNotNull() for f in R.REQUIRED_FIELDS}
    missing = F.array_compact(F.array(*[F.when(~present[f], F.lit(f)) for f in R.REQUIRED_FIELDS]))
    name_size, id_size = F.length(c("supplier.name")), F.length(c("supplier.tax_id"))
    bad_parts = (
        (present["supplier"] & (~name_size.between(2, 255) | ~id_size.between(6, 64)))
        | F.exists(c("items"), _broken)
    )
    bad_whole = (
        (c("total") <= 0) | (c("subtotal") < 0) | (F.length("number") > 100)
        | (c("due_date") < c("issue_date"))
    )
    labels = F.create_map(*[F.lit(x) for pair in R.FIELD_LABELS.items() for x in pair])
    detail = F.array_join(F.transform(
        c("missing_fields"), lambda f: F.concat(F.lit("No se encontró "), F.element_at(labels, f))
    ), "; ")
    nothing = ~(present["number"] | present["supplier"] | present["issue_date"])
    return (
        rows.withColumn("missing_fields", missing)
        .withColumn("route",
                    F.when(bad_parts, F.lit("ERROR"))
                    .when((F.size("missing_fields") > 0) & nothing, F.lit("NONE"))
                    .when(F.size("missing_fields") > 0, F.lit("PARTIAL"))
                    .when(F.size("items") == 0, F.lit("NO_ITEMS"))
                    .when(F.coalesce(bad_whole, F.lit(False)), F.lit("ERROR"))
                    .otherwise(F.lit("FULL")))
        .withColumn("message",
                    F.when(c("route") == "NONE", F.concat(detail, F.lit(R.MESSAGE_NONE)))
                    .when(c("route") == "PARTIAL", F.concat(detail, F.lit(R.MESSAGE_PARTIAL)))
                    .when(c("route") == "NO_ITEMS", F.lit(R.MESSAGE_NO_ITEMS + R.MESSAGE_NONE))
                    .otherwise(F.lit("")))
    )


def extract(
    docs: DataFrame, rules: Iterable[Rule] | DataFrame = DEFAULT_RULES, text: str = "text", windows: Windows = Windows()
) -> DataFrame:
    """All fields, patterns, items and the route for every document.

    ``rules`` are rules of the program, or a table of rules (see ``rules.rule_table``), which is read when the job
    runs. Columns of ``docs`` other than the text are kept.
    """
    known = in_plan(rules)
    book = known if isinstance(known, Known) else Stored()
    ready = known.attach(canonical(docs, text))
    found_fields = add_dates(add_number(with_supplier(ready, windows), book, windows), book, windows)
    money = add_amounts(found_fields, book).withColumn("_cur", _currency()).select(
        "*", F.col("_cur.code").alias("currency"), F.col("_cur.confident").alias("currency_confident")
    ).drop("_cur")
    rows = settle(add_items(money, book).drop("norm", "lines", "_rules", text))
    return route_extraction(rows)


def extraction_report(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long report: one row per document and field with status and winning pattern."""
    c = F.col

    def line(field: str, pattern: Column, status: Column | None = None) -> Column:
        state = status if status is not None else (
            F.when(pattern.isNotNull(), F.lit(R.OK)).otherwise(F.lit(R.NOT_FOUND))
        )
        return F.struct(
            F.lit(field).alias("field"), state.alias("status"),
            F.coalesce(pattern, F.lit("-")).alias("pattern"),
        )

    subtotal_status = (
        F.when(c("subtotal_derived"), F.lit(R.DERIVED))
        .when(c("subtotal_pattern").isNotNull(), F.lit(R.OK)).otherwise(F.lit(R.NOT_FOUND))
    )
    tax_status = F.when(c("tax_pattern").isNotNull(), F.lit(R.OK)).otherwise(F.lit(R.DEFAULTED))
    report = F.array_compact(F.array(
        line("number", c("number_pattern")),
        line("supplier", c("supplier_pattern")),
        F.when(c("supplier").isNotNull(), line("supplier_tax_id", c("tax_id_pattern"))),
        line("issue_date", c("issue_date_pattern")),
        line("total", c("total_pattern")),
        line("due_date", c("due_date_pattern")),
        line("tax", c("tax_pattern"), tax_status),
        line("subtotal", c("subtotal_pattern"), subtotal_status),
        line("items", c("item_pattern")),
    ))
    return rows.select(key, F.inline(report))


def pattern_hit_rates(report: DataFrame) -> DataFrame:
    """Documents per (field, status, pattern) and their share of the field, per mille."""
    counts = report.groupBy("field", "status", "pattern").agg(F.count("*").alias("documents"))
    # A row per field, status and pattern is left, so a window over a field is tiny; nothing is planned twice.
    return counts.withColumn("of_documents", F.sum("documents").over(Window.partitionBy("field"))).select(
        "field", "status", "pattern", "documents", "of_documents",
        F.expr("documents * 1000 div of_documents").alias("share_permille"),
    )
