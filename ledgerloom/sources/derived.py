"""Billing tables derived by Spark from the general tables of a data directory.

Money is worked out in whole cents and turned into decimals at the end. One
order is one invoice, whatever its number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.binding import built_once, settle
from ledgerloom.operators.numbering import dense_position
from ledgerloom.schemas import MONEY, QUANTITY
from ledgerloom.sources.tables import load

LINE_BUCKETS = 4096


def money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


_LINE_ORDER = ("l_linenumber", "part_id", "line_supplier", "quantity", "price_c", "tax_pct")


def _plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``lineitem`` that invoices are made of."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("line_supplier"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price_c"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax_pct"),
    )


def _line_bucket() -> Column:
    return (F.col("part_id") * 31 + F.col("line_supplier")) % LINE_BUCKETS


def _in_cents(lines: DataFrame, *at: Column) -> DataFrame:
    return (
        lines.withColumn("unit_c", F.expr("price_c div quantity"))
        # One cent up to three cents off the product for some parts; a few zero quantities.
        .withColumn("total_c", F.expr(
            "unit_c * quantity + CASE part_id % 40 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END"
        ))
        .select(
            F.col("l_orderkey").alias("invoice_id"), *at,
            "part_id", "line_supplier",
            F.expr("CASE WHEN part_id % 97 = 5 THEN 0 ELSE quantity END").alias("quantity"),
            "unit_c",
            F.expr("total_c * tax_pct div 100").alias("tax_c"),
            "total_c",
        )
    )


def line_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines in cents without a position: sums need none, and a list is put in order by ``place``."""
    lines = _plain_lines(spark, sf_dir).filter("l_orderkey IS NOT NULL")
    place = F.struct(F.coalesce(_line_bucket(), F.lit(-1)).alias("bucket"), *_LINE_ORDER)
    return _in_cents(lines.withColumn("place", place), F.col("place"))


def item_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines in cents: invoice_id, position, part, supplier, qty, unit_c, tax_c, total_c."""
    placed = dense_position(_plain_lines(spark, sf_dir), "l_orderkey", _line_bucket(), list(_LINE_ORDER), "line_at")
    return _in_cents(placed, F.col("line_at").cast("int").alias("position"))


def _items_from(cents: DataFrame) -> DataFrame:
    return cents.select(
        "invoice_id", "position",
        F.concat(F.lit("ARTICULO "), F.col("part_id").cast("string")).alias("description"),
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        money(F.col("unit_c")).alias("unit_price"),
        money(F.col("tax_c")).alias("tax_amount"),
        money(F.col("total_c")).alias("total"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items_from(item_cents(spark, sf_dir))


def _invoice_head(cents: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = cents.groupBy("invoice_id").agg(
        F.count("*").alias("n_items"),
        F.sum("total_c").alias("net_c"),
        F.sum("tax_c").alias("tax_c"),
        F.min("line_supplier").alias("supplier_id"),
    ).withColumn("o_orderkey", F.col("invoice_id"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("invoice_id")
    issued = F.to_date("o_orderdate")
    return sums.join(orders, "o_orderkey").select(
        "invoice_id", "n_items", "net_c", "tax_c", "supplier_id",
        issued.alias("issue_date"),
        F.expr(
            "CASE WHEN invoice_id % 7 = 3 THEN NULL "
            "WHEN invoice_id % 17 = 1 THEN date_sub(to_date(o_orderdate), 5) "
            "ELSE date_add(to_date(o_orderdate), 30) END"
        ).alias("due_date"),
        F.expr(
            "CASE invoice_id % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END"
        ).alias("currency"),
        F.concat(F.lit("FE"), (k % 500).cast("string")).alias("number"),
        F.expr(
            "CAST(o_orderdate AS TIMESTAMP) + make_interval(0,0,0,0,0,0,CAST(invoice_id % 86400 AS DECIMAL(18,6)))"
        ).alias("created_at"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with a few known faults, chosen by id; one in fifty names a supplier that is not registered."""
    head = _invoice_head(line_cents(spark, sf_dir), spark, sf_dir)
    subtotal = F.expr(
        "net_c + CASE invoice_id % 11 WHEN 1 THEN 700 WHEN 2 THEN 300 ELSE 0 END"
    )
    total = F.expr("net_c + tax_c + CASE WHEN invoice_id % 13 = 1 THEN 1600 ELSE 0 END")
    return head.select(
        "invoice_id",
        F.col("invoice_id").alias("document_id"),
        F.expr("CASE WHEN invoice_id % 50 = 49 THEN -supplier_id ELSE supplier_id END").alias("supplier_id"),
        "number", "issue_date", "due_date", "currency",
        money(subtotal).alias("subtotal"),
        money(F.col("tax_c")).alias("tax_amount"),
        money(total).alias("total"),
        "created_at",
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered suppliers."""
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        key.alias("supplier_id"),
        F.concat(F.lit("COMERCIAL ANDINA "), key.cast("string"), F.lit(" S.A.S")).alias("name"),
        (F.lit(900000000) + key).cast("string").alias("tax_id"),
        F.concat(F.lit("CALLE "), (key % 100).cast("string")).alias("address"),
        F.when(key % 3 == 0, F.concat(F.lit("+57 300 "), key.cast("string"))).alias("phone"),
        F.when(key % 2 == 0, F.concat(F.lit("ventas"), key.cast("string"), F.lit("@andina.example")))
        .alias("email"),
    )


def supplier_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier block of every processed invoice, in processing order.

    Forty tax ids are shared by all suppliers, some printed with blanks around.
    """
    head = _invoice_head(line_cents(spark, sf_dir), spark, sf_dir)
    tax_id = (F.lit(900000000) + F.col("supplier_id") % 40).cast("string")
    padded = F.when(F.col("invoice_id") % 5 == 0, F.concat(F.lit(" "), tax_id, F.lit("  "))).otherwise(tax_id)
    return head.select(
        F.col("invoice_id").alias("doc_id"),
        F.col("created_at").alias("processed_at"),
        F.concat(F.lit("COMERCIAL ANDINA "), F.col("supplier_id").cast("string")).alias("name"),
        padded.alias("tax_id"),
        F.concat(F.lit("CALLE "), (F.col("supplier_id") % 100).cast("string")).alias("address"),
    )


# ------------------------------------------------------------- printed amounts
def grouped(number: Column, mark: str) -> Column:
    """Whole number with a thousands mark."""
    plain = F.format_number(number, 0)
    return plain if mark == "," else F.translate(plain, ",", mark)


def printed(cents: Column, style: str) -> Column:
    """Cents as printed text: ``us`` 1,234.56, ``latam`` 1.234,56 or ``plain`` 1234.56."""
    whole = F.floor(cents / 100).cast("long")
    rest = F.lpad((cents % 100).cast("string"), 2, "0")
    if style == "us":
        return F.concat(grouped(whole, ","), F.lit("."), rest)
    if style == "latam":
        return F.concat(grouped(whole, "."), F.lit(","), rest)
    return F.concat(whole.cast("string"), F.lit("."), rest)


AMOUNT_STYLES = 12


def amount_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One amount per order line, written in twelve good and bad styles."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"),
    )
    c, whole = F.col("c"), F.expr("c div 100")
    style = (F.col("l_partkey") + F.col("l_suppkey")) % AMOUNT_STYLES
    raw = (
        F.when(style == 0, F.concat(F.lit("$"), printed(c, "us")))
        .when(style == 1, F.concat(F.lit("COP "), printed(c, "latam")))
        .when(style == 2, printed(c, "plain"))
        .when(style == 3, grouped(whole, "."))
        .when(style == 4, grouped(whole, ","))
        .when(style == 5, F.concat(whole.cast("string"), F.lit(","), F.expr("CAST(c % 10 AS STRING)")))
        .when(style == 6, F.concat(printed(c, "plain"), F.lit(".")))
        .when(style == 7, F.concat(F.lit("-"), whole.cast("string")))
        .when(style == 8, F.concat(whole.cast("string"), F.lit("."), F.expr("lpad(CAST(c % 10 AS STRING), 2, '0')"), F.lit("5")))
        .when(style == 9, F.lit(" "))
        .when(style == 10, F.concat(F.lit("abc "), whole.cast("string")))
    )
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", raw.alias("raw"))


# -------------------------------------------------------------- invoice texts
LAYOUTS = 8


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed invoices in eight layouts (by invoice id), one text per invoice.

    Each layout is made to reach other rules: 0 payment reference and billing
    period, 1 labels with item blocks, 2 dates below their labels, 3 bare number
    and a name near the tax id, 4 prefix number under an authorisation, 5 amount
    first, 6 no total, 7 not an invoice or one whose tax eats the total.
    """
    cents = line_cents(spark, sf_dir)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Artículo "), F.col("part_id").cast("string")),
        F.concat(F.greatest(F.col("quantity"), F.lit(1)).cast("string"), F.lit(".00")),
        printed(F.col("unit_c"), "us"), printed(F.col("tax_c"), "us"), printed(F.col("total_c"), "us"),
    )
    # Only for the layout that prints them; a printed text holds them all anyway, so they are put in order in its row.
    numbered = F.transform(F.array_sort("bs"), lambda b, at: F.concat_ws("\n", (at + 1).cast("string"), b["block"]))
    blocks = (
        cents.filter(f"invoice_id % {LAYOUTS} = 1")
        .groupBy("invoice_id")
        .agg(F.collect_list(F.struct("place", block.alias("block"))).alias("bs"))
        .select("invoice_id", F.array_join(numbered, "\n").alias("blocks"))
    )
    head = _invoice_head(cents, spark, sf_dir).join(blocks, "invoice_id", "left")
    amounts = {"net_us": F.col("net_c"), "tax_us": F.col("tax_c"), "gross_us": F.col("net_c") + F.col("tax_c")}
    # In a step of their own: the layouts mention them many times, and each mention is compiled anew.
    parts = {name: printed(cents, "us") for name, cents in amounts.items()}
    head = settle(head.withColumns(parts | {"whole_net": grouped(F.expr("net_c div 100"), "."), **_printed_dates()}))
    return head.select(F.col("invoice_id").alias("doc_id"), _printed_invoice().alias("text"))


def _printed_dates() -> dict[str, Column]:
    month = F.element_at(F.array(*[F.lit(m) for m in (
        "Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")]), F.month("issue_date"))
    return {
        "dmy": F.date_format("issue_date", "dd/MM/yyyy"),
        "named": F.concat(F.date_format("issue_date", "dd"), F.lit("-"), month, F.lit("-"), F.date_format("issue_date", "yyyy")),
        "due_dmy": F.date_format(F.date_add("issue_date", 30), "dd/MM/yyyy"),
    }


@built_once
def _printed_invoice() -> Column:
    """The text of an invoice row, by its layout."""
    k = F.col("invoice_id")
    big = (F.lit(10000) + k).cast("string")
    net, tax, gross = F.col("net_us"), F.col("tax_us"), F.col("gross_us")
    company = F.concat(F.lit("COMERCIAL ANDINA "), F.col("supplier_id").cast("string"))
    tax_id = (F.lit(900000000) + F.col("supplier_id")).cast("string")
    dmy, named, due_dmy = F.col("dmy"), F.col("named"), F.col("due_dmy")
    iso = F.date_format("issue_date", "yyyy-MM-dd")

    def latam(amount: Column) -> Column:
        return F.translate(amount, ",.", ".,")

    def text(*lines: Column | str) -> Column:
        return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])

    def line(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    layouts = [
        text("RESUMEN DE CUENTA", line(company, " S.A.S"), line("NIT ", tax_id, "-1"),
             line("PERIODO DE FACTURACION: ", named, " hasta 30-Dic-2030"),
             line("IMPUESTOS IVA: ", tax), "FECHA LIMITE DE PAGO", due_dmy,
             line("REFERENCIA DE PAGO ", (F.lit(7000000000) + k).cast("string")),
             line("TOTAL A PAGAR $", gross)),
        text(line("Emisor: ", company, " S.A.S"), line("NIT ", tax_id), line("Fecha de Emisión: ", dmy),
             line("Fecha de Vencimiento: ", due_dmy), line("Factura Electrónica de Venta No. FE", big),
             F.col("blocks"), line("Monto IVA: USD ", tax),
             line("Subtotal: USD ", net), line("Total a pagar: USD ", gross)),
        text(line("Almacén Norte - ", company, " S.A.S - NIT ", tax_id, "-3"),
             line("Factura Electrónica de Venta No. SV", big), "Fecha de Pago", "Fecha de Expedición", dmy,
             line("Total Valor: ", net)),
        text("Alquiler de herramienta por horas", "Powered by Caja Uno NIT 800.777.111-6", line("Entregado ", iso),
             line("NO: ", (F.lit(100000) + k % 1000000).cast("string")), "Depósito San Roque", "Tel 604 000",
             line("NIT: ", tax_id, "-4"), line("Valor Subtotal $ ", F.col("whole_net")),
             line("Cobrado Total: $ ", F.col("whole_net"))),
        text(line("Amarre y agua, ", dmy), line("KL - ", (F.lit(1000) + k % 1000000).cast("string")), "Se cobra en EUR",
             "Según resolución, factura electrónica de venta No. 70000112233445",
             line("Subtotal ", latam(net)), "Muelle Las Garzas", "Generada en Puerto Fácil NIT 830.100.200-7",
             line("NIT ", tax_id, "-0"), line("Total $", latam(gross))),
        text(line("TOTAL ", F.col("whole_net")), line("Fecha de Factura: ", iso), line(company, " LTDA."),
             line("NIT. ", tax_id, "-1"), line("Factura Electrónica de Venta FE", (F.lit(20) + k).cast("string")),
             "Numeración habilitada No. 55500066677"),
        text(line("Fecha de Emisión: ", dmy), F.when(k % 16 == 6, line("Emisor: ", company, " S.A.S")),
             line("Factura Electrónica de Venta No. FE", big), "Vuelva pronto"),
        F.when(k % 16 == 7, text("Comprobante interno", line("Total: ", gross)))
        .otherwise(text(line("Fecha de Emisión: ", dmy), line("NIT ", tax_id), line("Emisor: ", company, " S.A.S"),
                        line("Factura Electrónica de Venta No. FE", big),
                        line("Monto IVA: ", gross), line("Total a pagar: ", gross))),
    ]
    body = F.when(k % LAYOUTS == 0, layouts[0])
    for n, layout in enumerate(layouts[1:], start=1):
        body = body.when(k % LAYOUTS == n, layout)
    return body


# ------------------------------------------------------------- files and pages
def files(docs: DataFrame) -> DataFrame:
    """Incoming files made of ``documents`` rows: content behind a format header.

    Headers, extensions and declared types go by modulus of the id, so every
    audit rule is met. Works on a static and on a streaming table alike.
    """
    k = F.col("doc_id")
    body = F.encode("text", "UTF-8")

    def headed(header: bytes) -> Column:
        return F.concat(F.lit(header), body)

    content = (
        F.when(k % 7 == 0, headed(b"%PDF-1.7\n"))
        .when(k % 7 == 1, headed(b"x" * 100 + b"%PDF-1.4\n"))
        .when(k % 7 == 2, headed(b"\x89PNG\r\n\x1a\n"))
        .when(k % 7 == 3, headed(b"\xff\xd8\xff\xe0"))
        .when(k % 7 == 4, headed(b"plain "))
        .when(k % 7 == 5, headed(b"x" * 1100 + b"%PDF-1.4\n"))
        .otherwise(F.lit(b""))
    )
    extension = F.element_at(
        F.array(*[F.lit(e) for e in (".pdf", ".PNG", ".jpg", ".jpeg", ".txt", "")]), (k % 6 + 1).cast("int")
    )
    mime = F.element_at(
        F.array(F.lit(None).cast("string"), F.lit("application/pdf; charset=binary"), F.lit(" Image/PNG "),
                F.lit("text/plain"), F.lit("")),
        (k % 5 + 1).cast("int"),
    )
    return docs.select(
        "doc_id",
        F.concat(F.lit("C:\\entrada/"), F.col("lang"), F.lit(" fáctura(Ñ) "), k.cast("string"), extension)
        .alias("filename"),
        mime.alias("declared_mime"),
        F.expr("timestamp_ntz'2023-11-14 22:13:20' + make_dt_interval(CAST(doc_id % 3650 AS INT))")
        .alias("received_at"),
        content.alias("content"),
    )


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(load(spark, sf_dir, "documents"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a page; every third page has an OCR reading."""
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "embedded_text")
    )
    return rows.withColumn(
        "ocr_text",
        F.when(F.col("page_no") % 3 == 0, F.concat(F.lit("OCR "), F.col("embedded_text"))).otherwise(F.lit("  ")),
    )


# -------------------------------------------------------------- jobs and events
_KINDS = {"view": "start", "purchase": "complete", "click": "fail", "error": "transient", "signup": "upload"}


def job_events(events: DataFrame) -> DataFrame:
    """Lifecycle events of jobs from the ``events`` table (static or streaming)."""
    kind = F.lit(None).cast("string")
    for name, value in _KINDS.items():
        kind = F.when(F.col("event_type") == name, F.lit(value)).otherwise(kind)
    return events.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("failed at "), F.col("event_id").cast("string")))
        .alias("message"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("invoice_id"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged errors with code, retries so far, override and time-out flag."""
    k = F.col("event_id")
    codes = F.array(*[F.lit(c) for c in (
        "ocr_extraction_failed", "llm_extraction_failed", "storage_error", "invalid_file",
        "llm_extraction_partial", "document_processing_failed", "persistence_error")])
    return load(spark, sf_dir, "events").filter("event_type IN ('error', 'click')").select(
        "event_id", F.element_at(codes, (k % 7 + 1).cast("int")).alias("code"),
        (F.col("user_id") % 5).cast("int").alias("retries"),
        F.when(k % 11 == 6, F.lit(False)).alias("retryable"),
        (k % 29 == 0).alias("timed_out"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One processing job per order."""
    k = F.col("o_orderkey")
    status = F.expr(
        "CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'PENDING' "
        "WHEN o_orderkey % 2 = 0 THEN 'PROCESSING' ELSE 'FAILED' END"
    )
    placed = F.col("o_orderdate").cast("timestamp")
    started = F.timestamp_seconds(F.unix_seconds(placed) + k % 100)
    reasons = [
        "No se encontró el número de factura; No se encontró el total. Revise los patrones.",
        "No se encontró el total", "Processing timed out after 600s", " ; No se encontró la fecha de emisión. ",
    ]
    message = F.element_at(F.array(*[F.lit(r) for r in reasons]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(
        k.alias("job_id"), k.alias("document_id"), status.alias("status"), "o_custkey",
        placed.alias("created_at"), started.alias("_started"), message.alias("_message"),
    ).select(
        "job_id", "document_id", "status",
        F.when(F.col("status") == "PENDING", 0).otherwise(1 + k_mod("o_custkey", 3)).cast("int").alias("attempts"),
        F.when(F.col("status") != "PENDING", F.col("_started")).alias("started_at"),
        F.when(F.col("status").isin("COMPLETED", "FAILED"),
               F.timestamp_seconds(F.unix_seconds("_started") + k_mod("o_custkey", 600))).alias("finished_at"),
        F.when((F.col("status") == "FAILED") & (F.col("job_id") % 10 != 9), F.col("_message")).alias("error_message"),
        "created_at",
    )


def k_mod(column: str, n: int) -> Column:
    return F.col(column) % n


# ------------------------------------------------------------- replies, payloads
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies holding the known truth of each invoice, wrapped six ways.

    0 bare, 1 fenced, 2 inside prose, 3 in the reasoning field, 4 a JSON list,
    5 cut off. Some payloads break one contract rule each.
    """
    k = F.col("invoice_id")
    amounts = {"net": F.col("net_c"), "tax": F.col("tax_c"), "gross": F.col("net_c") + F.col("tax_c")}
    # In steps of their own: what a branch mentions again is worked out, and compiled, anew for each mention.
    head = settle(_invoice_head(line_cents(spark, sf_dir), spark, sf_dir).withColumns(
        {name: printed(cents, "plain") for name, cents in amounts.items()}
    ))
    net, tax, gross = (F.col(name) for name in amounts)
    body = F.struct(
        F.when(k % 19 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" R-"), k.cast("string"))).alias("number"),
        F.when(k % 19 == 4, F.lit("not a day")).otherwise(F.date_format("issue_date", "yyyy-MM-dd")).alias("date"),
        F.date_format("due_date", "yyyy-MM-dd").alias("due_date"),
        F.when(k % 19 == 5, F.lit("EURO")).otherwise(F.lower("currency")).alias("currency"),
        F.when(k % 2 == 0, F.translate(net, ".", ",")).otherwise(net).alias("subtotal"),
        F.when(k % 19 != 6, tax).alias("tax"),
        F.when(k % 19 == 7, F.lit("0")).otherwise(gross).alias("total"),
        F.lit("ignored").alias("comment"),
        F.when(k % 19 != 8, F.struct(
            F.concat(F.lit("COMERCIAL ANDINA "), F.col("supplier_id").cast("string")).alias("name"),
            F.when(k % 19 == 9, F.lit("123")).otherwise((F.lit(900000000) + F.col("supplier_id")).cast("string"))
            .alias("tax_id"),
            F.when(k % 19 == 10, F.lit("no-at-sign")).otherwise(F.lit("ventas@andina.example")).alias("email"),
        )).alias("supplier"),
        F.when(k % 3 != 0, F.array(F.struct(
            F.lit("Servicio").alias("description"),
            F.when(k % 19 == 11, F.lit("-1")).otherwise(F.lit("1")).alias("quantity"),
            net.alias("unit_price"), tax.alias("tax"), net.alias("total"),
        ))).alias("items"),
    )
    written = settle(head.select(k.alias("doc_id"), F.to_json(body).alias("js")))
    js, way = F.col("js"), F.col("doc_id") % 6
    return written.select(
        "doc_id",
        F.when(way == 0, js)
        .when(way == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
        .when(way == 2, F.concat(F.lit("Here it is: "), js, F.lit(" Anything else?")))
        .when(way == 3, F.lit("  "))
        .when(way == 4, F.concat(F.lit("["), js, F.lit("]")))
        .otherwise(F.left(js, F.length(js) - 1)).alias("content"),
        F.when(way == 3, F.concat(F.lit("thinking... "), js)).alias("reasoning"),
    )


def two_source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice texts split over the embedded and the OCR layer of a document.

    By id: 0 whole text embedded, 1 whole text by OCR, 2 cut in two with the
    total (and another number) in the OCR part, 3 both layers empty of fields.
    """
    texts = invoice_texts(spark, sf_dir)
    k = F.col("doc_id")
    way = F.floor(k / LAYOUTS) % 4
    nothing = F.lit("Sin datos")
    at = F.instr("text", "Total")
    return texts.select(
        "doc_id",
        F.when(way == 0, F.col("text")).when(way == 1, nothing)
        .when(way == 2, F.when(at > 1, F.left("text", at - 1)).otherwise(F.col("text")))
        .otherwise(nothing).alias("embedded_text"),
        F.when(way == 0, F.lit("")).when(way == 1, F.col("text"))
        .when(way == 2, F.when(at > 1, F.concat(
            F.substring("text", at, F.length("text")), F.lit("\nREFERENCIA DE PAGO: "),
            (F.lit(5000000000) + k).cast("string"))).otherwise(F.lit("")))
        .otherwise(nothing).alias("ocr_text"),
    )
