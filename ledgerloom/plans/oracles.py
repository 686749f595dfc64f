"""SQL counterparts of the registered queries, for any ANSI engine with DuckDB's dialect.

They start from the same general tables. For extraction the expected values
come from the columns the printed texts were made of, not from a second parser.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

AS_OF = "DATE '1998-06-01'"
MAX_BYTES = 6000


def m(cents: str) -> str:
    """Cents as decimal text."""
    return f"CAST(CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS VARCHAR)"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def v(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def n(expr: str) -> str:
    """NULL as empty text."""
    return f"coalesce(CAST({expr} AS VARCHAR), '')"


# ------------------------------------------------------------- shared relations
ITEMS = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS part_id, l_suppkey AS line_supplier,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_pct
  FROM lineitem),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (part_id * 31 + line_supplier) % 4096, l_linenumber, part_id,
            line_supplier, q, price_c, tax_pct) - 1 AS line_at
  FROM lines),
priced AS (
  SELECT *, price_c // q AS unit_c,
         (price_c // q) * q + CASE part_id % 40 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS total_c
  FROM placed),
items AS (
  SELECT l_orderkey AS invoice_id, CAST(line_at AS BIGINT) AS position,
         part_id, line_supplier, CASE WHEN part_id % 97 = 5 THEN 0 ELSE q END AS quantity, unit_c,
         total_c * tax_pct // 100 AS tax_c, total_c
  FROM priced)
"""
HEAD = ITEMS + """,
sums AS (
  SELECT invoice_id, count(*) AS n_items, CAST(sum(total_c) AS BIGINT) AS net_c,
         CAST(sum(tax_c) AS BIGINT) AS tax_c, min(line_supplier) AS supplier_id
  FROM items GROUP BY invoice_id),
head AS (
  SELECT s.*, CAST(o_orderdate AS DATE) AS issue_date,
         CASE WHEN invoice_id % 7 = 3 THEN NULL
              WHEN invoice_id % 17 = 1 THEN CAST(o_orderdate AS DATE) - 5
              ELSE CAST(o_orderdate AS DATE) + 30 END AS due_date,
         CASE invoice_id % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
         'FE' || CAST(invoice_id % 500 AS VARCHAR) AS number,
         o_orderdate + to_seconds(invoice_id % 86400) AS created_at
  FROM sums s JOIN orders ON o_orderkey = s.invoice_id)
"""
INVOICES = HEAD + """,
invoices AS (
  SELECT invoice_id, invoice_id AS document_id,
         CASE WHEN invoice_id % 50 = 49 THEN -supplier_id ELSE supplier_id END AS supplier_id, number, issue_date, due_date, currency,
         net_c + CASE invoice_id % 11 WHEN 1 THEN 700 WHEN 2 THEN 300 ELSE 0 END AS subtotal_c,
         tax_c, net_c + tax_c + CASE WHEN invoice_id % 13 = 1 THEN 1600 ELSE 0 END AS total_c,
         created_at, n_items, net_c
  FROM head)
"""
SUPPLIERS = """,
suppliers AS (
  SELECT s_suppkey AS supplier_id, 'COMERCIAL ANDINA ' || s_suppkey || ' S.A.S' AS name,
         CAST(900000000 + s_suppkey AS VARCHAR) AS tax_id, 'CALLE ' || (s_suppkey % 100) AS address,
         CASE WHEN s_suppkey % 3 = 0 THEN '+57 300 ' || s_suppkey END AS phone,
         CASE WHEN s_suppkey % 2 = 0 THEN 'ventas' || s_suppkey || '@andina.example' END AS email
  FROM supplier)
"""
TRUTH = HEAD + """,
printed AS (
  SELECT h.*, invoice_id AS doc_id, invoice_id AS k, invoice_id % 8 AS lay,
         CASE WHEN invoice_id % 8 < 7 THEN CAST(invoice_id % 8 AS VARCHAR)
              WHEN invoice_id % 16 = 7 THEN '7a' ELSE '7b' END AS l,
         'COMERCIAL ANDINA ' || supplier_id AS company, CAST(900000000 + supplier_id AS VARCHAR) AS base_id,
         net_c + h.tax_c AS gross_c, net_c // 100 * 100 AS whole_c
  FROM head h),
truth AS (
  SELECT doc_id, k, l, n_items, net_c, tax_c AS printed_tax_c, gross_c, supplier_id, due_date AS known_due,
    currency AS known_currency, issue_date AS known_issue,
    CASE l WHEN '0' THEN CAST(7000000000 + k AS VARCHAR) WHEN '1' THEN 'FE' || (10000 + k)
      WHEN '2' THEN 'SV' || (10000 + k) WHEN '3' THEN CAST(100000 + k % 1000000 AS VARCHAR)
      WHEN '4' THEN 'KL-' || (1000 + k % 1000000) WHEN '5' THEN 'FE' || (20 + k)
      WHEN '6' THEN 'FE' || (10000 + k) WHEN '7b' THEN 'FE' || (10000 + k) END AS number,
    CASE l WHEN '0' THEN 'referencia_de_pago' WHEN '3' THEN 'numero_solo_prefijo_no'
      WHEN '4' THEN 'numero_prefijo_guion_linea' WHEN '7a' THEN NULL
      ELSE 'factura_electronica_venta_no' END AS number_pattern,
    CASE WHEN l IN ('0', '1', '2', '7b') OR (l = '6' AND k % 16 = 6) THEN company || ' S.A.S'
      WHEN l = '3' THEN 'DEPOSITO SAN ROQUE' WHEN l = '4' THEN 'MUELLE LAS GARZAS'
      WHEN l = '5' THEN company || ' LTDA.' END AS name,
    CASE WHEN l IN ('0', '2', '5') THEN 'primera_linea_empresa' WHEN l IN ('3', '4') THEN 'nit_con_nombre_cercano'
      WHEN l IN ('1', '7b') OR (l = '6' AND k % 16 = 6) THEN 'etiqueta_emisor' END AS supplier_pattern,
    CASE WHEN l = '6' AND k % 16 = 6 THEN 'SIN-NIT-COMERC' WHEN l IN ('0', '5') THEN base_id || '-1'
      WHEN l IN ('1', '7b') THEN base_id WHEN l = '2' THEN base_id || '-3' WHEN l = '3' THEN base_id || '-4'
      WHEN l = '4' THEN base_id || '-0' END AS tax_id,
    CASE WHEN l IN ('0', '1', '2', '3', '4', '5', '7b') THEN 'nit_generico' END AS tax_id_pattern,
    CASE WHEN l <> '7a' THEN issue_date END AS issue_date,
    CASE l WHEN '0' THEN 'periodo_de_facturacion' WHEN '1' THEN 'fecha_de_emision'
      WHEN '2' THEN 'fecha_de_expedicion_linea_siguiente' WHEN '3' THEN 'primera_fecha_del_documento'
      WHEN '4' THEN 'primera_fecha_del_documento' WHEN '5' THEN 'fecha_de_factura'
      WHEN '6' THEN 'fecha_de_emision' WHEN '7b' THEN 'fecha_de_emision' END AS issue_date_pattern,
    CASE WHEN l IN ('0', '1') THEN issue_date + 30 WHEN l = '2' THEN issue_date END AS due_date,
    CASE l WHEN '0' THEN 'fecha_limite_de_pago_linea_siguiente' WHEN '1' THEN 'fecha_de_vencimiento'
      WHEN '2' THEN 'fecha_de_pago_linea_siguiente' END AS due_date_pattern,
    CASE WHEN l IN ('0', '1', '4', '7a', '7b') THEN gross_c WHEN l = '2' THEN net_c
      WHEN l IN ('3', '5') THEN whole_c END AS total_c,
    CASE WHEN l IN ('0', '1', '7b') THEN 'total_a_pagar' WHEN l = '2' THEN 'total_valor'
      WHEN l IN ('3', '4', '5', '7a') THEN 'total_simple' END AS total_pattern,
    CASE WHEN l IN ('0', '1') THEN tax_c WHEN l = '7b' THEN gross_c ELSE 0 END AS tax_c,
    CASE l WHEN '0' THEN 'impuestos_iva_inline' WHEN '1' THEN 'monto_iva' WHEN '7b' THEN 'monto_iva' END AS tax_pattern,
    CASE WHEN l IN ('1', '4') THEN net_c WHEN l = '3' THEN whole_c END AS psub_c,
    CASE WHEN l IN ('0', '2', '3', '5', '7b') THEN 'COP' WHEN l = '4' THEN 'EUR' ELSE 'USD' END AS currency,
    l NOT IN ('6', '7a') AS confident
  FROM printed),
solved AS (
  SELECT *, derived, CASE WHEN derived THEN total_c - tax_c ELSE psub_c END AS sub_c,
    CASE WHEN l = '7a' THEN 'NONE' WHEN l = '6' THEN 'PARTIAL' WHEN l = '7b' THEN 'NO_ITEMS' ELSE 'FULL' END AS route,
    CASE WHEN l = '7a' THEN 'number|supplier|issue_date' WHEN l = '6' AND k % 16 = 6 THEN 'total'
      WHEN l = '6' THEN 'supplier|total' ELSE '' END AS missing
  FROM (SELECT *, total_c IS NOT NULL AND (psub_c IS NULL OR psub_c + tax_c <> total_c) AS derived FROM truth))
"""
REPLIES = """,
wrapped AS (
  SELECT *, invoice_id AS kk,
    CASE invoice_id % 6 WHEN 4 THEN 'not_object' WHEN 5 THEN 'malformed' ELSE 'object' END AS outcome,
    CASE WHEN invoice_id % 19 = 3 THEN '' ELSE 'R-' || invoice_id END AS r_number,
    CASE WHEN invoice_id % 19 = 4 THEN NULL ELSE issue_date END AS r_issue,
    CASE WHEN invoice_id % 19 = 5 THEN 'EURO' ELSE currency END AS r_currency,
    CASE WHEN invoice_id % 19 = 6 THEN 0 ELSE tax_c END AS r_tax_c,
    CASE WHEN invoice_id % 19 = 7 THEN 0 ELSE net_c + tax_c END AS r_total_c
  FROM head),
payloads AS (
  SELECT *, concat_ws('|',
    CASE WHEN kk % 19 = 3 THEN 'number' END, CASE WHEN kk % 19 = 4 THEN 'issue_date' END,
    CASE WHEN kk % 19 = 5 THEN 'currency' END, CASE WHEN kk % 19 = 7 THEN 'total' END,
    CASE WHEN kk % 19 = 8 THEN 'supplier' END, CASE WHEN kk % 19 = 9 THEN 'supplier.tax_id' END,
    CASE WHEN kk % 19 = 10 THEN 'supplier.email' END,
    CASE WHEN kk % 19 = 11 AND kk % 3 <> 0 THEN 'items.quantity' END,
    CASE WHEN due_date < r_issue THEN 'due_before_issue' END) AS violations
  FROM wrapped WHERE outcome = 'object')
"""
JOBS = """
jobs AS (
  SELECT job_id, job_id AS document_id, status, created_at, cust,
    CASE WHEN status = 'PENDING' THEN 0 ELSE 1 + cust % 3 END AS attempts,
    CASE WHEN status IN ('COMPLETED', 'FAILED') THEN cust % 600 END AS seconds,
    CASE WHEN status = 'FAILED' AND job_id % 10 <> 9 THEN CASE cust % 4
      WHEN 0 THEN 'No se encontró el número de factura; No se encontró el total. Revise los patrones.'
      WHEN 1 THEN 'No se encontró el total' WHEN 2 THEN 'Processing timed out after 600s'
      ELSE ' ; No se encontró la fecha de emisión. ' END END AS error_message
  FROM (SELECT o_orderkey AS job_id, o_custkey AS cust, o_orderdate AS created_at,
          CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'PENDING'
               WHEN o_orderkey % 2 = 0 THEN 'PROCESSING' ELSE 'FAILED' END AS status FROM orders))
"""
EVENTS = """
log AS (
  SELECT user_id AS job_id, event_id, ts,
    CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'fail'
      WHEN 'error' THEN 'transient' ELSE 'upload' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events)
"""


def sql(name: str, text: str) -> None:
    ORACLES[name] = text.strip()


# ------------------------------------------------------------ sources and ingest
FILES = f"""
files AS (
  SELECT doc_id, lang, doc_id AS k,
    CASE doc_id % 7 WHEN 0 THEN 9 WHEN 1 THEN 109 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 6
      WHEN 5 THEN 1109 ELSE 0 END + CASE WHEN doc_id % 7 = 6 THEN 0 ELSE strlen(text) END AS size_bytes,
    CASE doc_id % 7 WHEN 0 THEN 'PDF' WHEN 1 THEN 'PDF' WHEN 2 THEN 'PNG' WHEN 3 THEN 'JPEG' END AS format,
    CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'txt' ELSE '' END AS ext,
    CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.txt' ELSE '' END AS suffix,
    CASE doc_id % 5 WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/plain' ELSE '' END AS mime,
    TIMESTAMP '2023-11-14 22:13:20' + to_days(CAST(doc_id % 3650 AS INTEGER)) AS received_at
  FROM documents),
kinds AS (
  SELECT *, CASE WHEN format = 'PDF' THEN 'PDF' WHEN format IS NOT NULL THEN 'IMAGE' END AS family,
    CASE format WHEN 'PDF' THEN 'application/pdf' WHEN 'PNG' THEN 'image/png' WHEN 'JPEG' THEN 'image/jpeg' END AS own_mime,
    lang || '_factura_N__' || k || suffix AS safe_name
  FROM files),
audited AS (
  SELECT *, CASE WHEN size_bytes > {MAX_BYTES} THEN 'too_large' WHEN size_bytes = 0 THEN 'empty'
    WHEN ext IN ('txt', '') THEN 'extension' WHEN mime = 'text/plain' THEN 'mime'
    WHEN format IS NULL THEN 'signature' WHEN (ext = 'pdf') <> (family = 'PDF') THEN 'family'
    WHEN mime <> '' AND (mime = 'application/pdf') <> (family = 'PDF') THEN 'mime_content' ELSE '' END AS reason
  FROM kinds)
"""
REGISTERED = f"""
SELECT k AS document_id, safe_name AS filename, CASE WHEN mime = '' THEN own_mime ELSE mime END AS content_type,
  size_bytes, strftime(received_at, '%Y/%m') || '/' || k || '__' || safe_name AS storage_path,
  family AS document_type, 'RECEIVED' AS status, {ts('received_at')} AS created_at,
  'PENDING' AS job_status, 0 AS attempts
FROM audited WHERE reason = ''
"""
sql("ingest_file_audit", f"""
WITH {FILES}
SELECT doc_id, size_bytes, reason,
  CASE reason WHEN '' THEN '' WHEN 'too_large' THEN 'file_too_large' WHEN 'empty' THEN 'empty_file'
    ELSE 'invalid_file' END AS error_code,
  CASE WHEN reason = '' THEN family ELSE '' END AS document_type,
  CASE WHEN reason <> '' THEN '' WHEN mime = '' THEN own_mime ELSE mime END AS mime_type
FROM audited""")
sql("ingest_sent_files", f"""
WITH {FILES.replace("1109 ELSE 0 END +", "1109 ELSE 0 END + CASE WHEN doc_id % 7 = 6 THEN 0 ELSE 1 END +")}
SELECT doc_id, size_bytes, reason,
  CASE reason WHEN '' THEN '' WHEN 'too_large' THEN 'file_too_large' WHEN 'empty' THEN 'empty_file'
    ELSE 'invalid_file' END AS error_code,
  CASE WHEN reason = '' THEN family ELSE '' END AS document_type,
  CASE WHEN reason <> '' THEN '' WHEN mime = '' THEN own_mime ELSE mime END AS mime_type,
  CASE WHEN reason = '' THEN 'RECEIVED' ELSE '' END AS streamed
FROM audited""")
sql("ingest_magic_sniff", f"""
WITH {FILES}
SELECT doc_id, {n('format')} AS format, {n('family')} AS document_type, {n('own_mime')} AS mime_type FROM kinds""")
sql("ingest_safe_filename", f"WITH {FILES} SELECT doc_id, safe_name AS filename FROM kinds")
sql("ingest_storage_layout", f"""
WITH {FILES}
SELECT doc_id, strftime(received_at, '%Y/%m') || '/' || k || '__' || safe_name AS storage_path,
  CAST(year(received_at) AS INTEGER) AS year, CAST(month(received_at) AS INTEGER) AS month FROM kinds""")
# Registration takes files up to the default limit, which none of these exceeds.
ALL_FILES = FILES.replace(f"size_bytes > {MAX_BYTES}", "size_bytes > 10485760")
sql("ingest_register", f"WITH {ALL_FILES} {REGISTERED}")
sql("stream_ingest", f"WITH {ALL_FILES} {REGISTERED}")
sql("page_text_assembly", r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
pages AS (SELECT doc_id, unnest(ps) AS e, unnest(range(len(ps))) AS page_no FROM raw),
clean AS (SELECT doc_id, page_no, regexp_replace(e, '^\s+|\s+$', '', 'g') AS t,
  CASE WHEN page_no % 3 = 0 THEN regexp_replace('OCR ' || e, '^\s+|\s+$', '', 'g') ELSE '' END AS o FROM pages),
chosen AS (SELECT doc_id, page_no, length(t) >= 40 AS emb,
  CASE WHEN length(t) >= 40 OR o = '' THEN t ELSE o END AS x FROM clean)
SELECT doc_id, md5(string_agg(x, chr(10) || chr(10) ORDER BY page_no)) AS text_md5,
  count(*) AS page_count,
  concat_ws('+', CASE WHEN count_if(emb) > 0 THEN 'embedded-text' END,
                 CASE WHEN count_if(NOT emb) > 0 THEN 'tesseract' END)
  || CASE WHEN count_if(NOT emb) > 0 THEN ' (ocr_pages=' || count_if(NOT emb) || ')' ELSE '' END AS method
FROM chosen GROUP BY doc_id""")
sql("markup_to_lines", r"""
WITH split AS (
  SELECT page_id, list_filter(list_transform(
    string_split(regexp_replace(html, '<[^>]+>', chr(10), 'g'), chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x <> '---') AS ls
  FROM pages)
SELECT page_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM split""")
sql("lookup_by_key", f"""
WITH {INVOICES} {SUPPLIERS},
newest AS (SELECT document_id, arg_max(invoice_id, (created_at, invoice_id)) AS invoice_id FROM invoices GROUP BY document_id)
SELECT 'supplier' AS kind, supplier_id AS id, tax_id AS found FROM suppliers
WHERE tax_id IN (SELECT CAST(900000000 + o_custkey AS VARCHAR) FROM orders)
UNION ALL
SELECT 'invoice', document_id, {v('invoice_id')} FROM newest WHERE document_id IN (SELECT o_orderkey FROM orders)""")

# ------------------------------------------------------------------- extraction
def _runs(text: str) -> str:
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        least = 3 if letter in "LRSC" else 2
        text = f"regexp_replace({text}, '{letter}{{{least},}}', '{letter}', 'g')"
    return text


NORMAL = rf"""
folded AS (SELECT doc_id, upper(strip_accents(replace(text, 'ß', 'ss'))) AS t FROM documents),
cleaned AS (
  SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)),
    lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM folded),
normal AS (SELECT doc_id, {_runs("array_to_string(ls, chr(10))")} AS norm FROM cleaned)
"""
sql("text_normalize", f"WITH {NORMAL} SELECT doc_id, length(norm) AS n_chars, md5(norm) AS norm_md5 FROM normal")
sql("text_lines", f"""
WITH {NORMAL}, parts AS (SELECT doc_id, string_split(norm, chr(10)) AS ls FROM normal WHERE norm <> '')
SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, md5(unnest(ls)) AS line_md5 FROM parts""")
sql("extract_number", f"WITH {TRUTH} SELECT doc_id, {n('number')} AS number, {n('number_pattern')} AS number_pattern FROM truth")
sql("exclude_authorization", f"""
WITH {TRUTH}
SELECT doc_id, 0 AS match_no, CASE WHEN l = '4' THEN '70000112233445' ELSE number END AS value,
  CASE WHEN l = '4' THEN 'true' ELSE 'false' END AS excluded
FROM truth WHERE l IN ('1', '2', '4', '5', '6', '7b')""")
sql("extract_supplier", f"WITH {TRUTH} SELECT doc_id, {n('name')} AS name, {n('supplier_pattern')} AS supplier_pattern FROM truth")
sql("extract_tax_id", f"WITH {TRUTH} SELECT doc_id, {n('tax_id')} AS tax_id, {n('tax_id_pattern')} AS tax_id_pattern FROM truth")
sql("extract_labelled_date", f"""
WITH {TRUTH}
SELECT doc_id, {n('issue_date')} AS issue_date, {n('issue_date_pattern')} AS issue_date_pattern,
  {n('due_date')} AS due_date, {n('due_date_pattern')} AS due_date_pattern FROM truth""")
sql("extract_any_date", f"""
WITH {TRUTH}
SELECT doc_id, {n("CASE WHEN l = '7a' THEN NULL WHEN l = '0' THEN known_issue + 30 ELSE known_issue END")} AS any_date
FROM truth""")
sql("parse_date", f"""
SELECT o_orderkey, upper(CASE o_orderkey % 6
    WHEN 0 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00'
    WHEN 2 THEN strftime(o_orderdate, '%d-') || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Set','Oct','Nov','Dic'][month(o_orderdate)] || strftime(o_orderdate, '-%Y')
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' / 30/02/2020'
    WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || ' y 01/02/2020'
    ELSE '31-Xyz-' || year(o_orderdate) END) AS raw,
  CASE o_orderkey % 6 WHEN 3 THEN '' WHEN 4 THEN '2020-02-01' WHEN 5 THEN ''
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM orders""")
sql("extract_amounts", f"""
WITH {TRUTH}
SELECT doc_id, {n(m('total_c'))} AS total, {n('total_pattern')} AS total_pattern, {n(m('tax_c'))} AS tax,
  {n('tax_pattern')} AS tax_pattern, {n(m('psub_c'))} AS printed_subtotal FROM truth""")
sql("extract_currency", f"""
WITH {TRUTH}, {NORMAL}
SELECT 'invoice' AS kind, doc_id, currency AS code, {v('confident')} AS confident FROM truth
UNION ALL
SELECT 'document', doc_id, CASE WHEN iso <> '' THEN iso WHEN marker THEN 'COP' ELSE 'USD' END,
  {v("iso <> '' OR marker")}
FROM (SELECT doc_id, regexp_extract(norm, '\\b(COP|USD|EUR|GBP)\\b', 1) AS iso,
        regexp_matches(norm, 'NIT|DIAN|COP|BOGOT|MEDELL|CUFE') AS marker FROM normal)""".replace("\\\\b", "\\b"))
sql("extract_item_rows", f"""
WITH {ITEMS}
SELECT invoice_id AS doc_id, position, 'ARTICULO ' || part_id AS description,
  {m('greatest(quantity, 1) * 100')} AS quantity, {m('unit_c')} AS unit_price, {m('tax_c')} AS tax, {m('total_c')} AS total
FROM items WHERE invoice_id % 8 = 1""")
sql("synthesize_item", f"""
WITH {TRUTH}
SELECT doc_id, 'Conceptos facturados (agregado del documento)' AS description, '1.00' AS quantity,
  {m('sub_c')} AS unit_price, {m('tax_c')} AS tax, {m('sub_c')} AS total
FROM solved WHERE l <> '1' AND sub_c > 0""")
sql("reconcile_subtotal", f"""
WITH {TRUTH}
SELECT doc_id, {n(m('sub_c'))} AS subtotal,
  CASE WHEN derived THEN 'calculado_como_total_menos_impuesto' WHEN psub_c IS NOT NULL THEN 'subtotal' ELSE '' END AS subtotal_pattern,
  {v('derived')} AS subtotal_derived FROM solved""")
REPORT = f"""{TRUTH},
report AS (
  SELECT doc_id, f.field, f.status, f.pattern FROM (SELECT doc_id, unnest([
    {{'field': 'number', 'status': if(number_pattern IS NULL, 'no_encontrado', 'ok'), 'pattern': coalesce(number_pattern, '-')}},
    {{'field': 'supplier', 'status': if(name IS NULL, 'no_encontrado', 'ok'), 'pattern': coalesce(supplier_pattern, '-')}},
    {{'field': if(name IS NULL, NULL, 'supplier_tax_id'), 'status': if(tax_id_pattern IS NULL, 'no_encontrado', 'ok'), 'pattern': coalesce(tax_id_pattern, '-')}},
    {{'field': 'issue_date', 'status': if(issue_date_pattern IS NULL, 'no_encontrado', 'ok'), 'pattern': coalesce(issue_date_pattern, '-')}},
    {{'field': 'due_date', 'status': if(due_date_pattern IS NULL, 'no_encontrado', 'ok'), 'pattern': coalesce(due_date_pattern, '-')}},
    {{'field': 'total', 'status': if(total_pattern IS NULL, 'no_encontrado', 'ok'), 'pattern': coalesce(total_pattern, '-')}},
    {{'field': 'tax', 'status': if(tax_pattern IS NULL, 'por_defecto', 'ok'), 'pattern': coalesce(tax_pattern, '-')}},
    {{'field': 'subtotal', 'status': CASE WHEN derived THEN 'derivado' WHEN psub_c IS NULL THEN 'no_encontrado' ELSE 'ok' END,
      'pattern': CASE WHEN derived THEN 'calculado_como_total_menos_impuesto' WHEN psub_c IS NULL THEN '-' ELSE 'subtotal' END}},
    {{'field': 'items', 'status': if(l = '1', 'ok', 'no_encontrado'), 'pattern': if(l = '1', 'fila_estructurada', '-')}}
  ]) AS f FROM solved) WHERE f.field IS NOT NULL)
"""
sql("extraction_report", f"WITH {REPORT} SELECT * FROM report")
sql("pattern_hit_rates", f"""
WITH {REPORT}
SELECT field, status, pattern, count(*) AS documents,
  CAST(sum(count(*)) OVER (PARTITION BY field) AS BIGINT) AS of_documents,
  CAST(count(*) * 1000 // sum(count(*)) OVER (PARTITION BY field) AS BIGINT) AS share_permille
FROM report GROUP BY field, status, pattern""")
sql("route_extraction", f"""
WITH {TRUTH}
SELECT doc_id, route, missing AS missing_fields, CASE route
  WHEN 'NO_ITEMS' THEN 'No se encontró las líneas de la factura. Revise los patrones del extractor o use otro formato.'
  WHEN 'FULL' THEN ''
  ELSE array_to_string(list_transform(string_split(missing, '|'), lambda f: 'No se encontró ' || CASE f
      WHEN 'number' THEN 'el número de factura' WHEN 'supplier' THEN 'la entidad (proveedor)'
      WHEN 'issue_date' THEN 'la fecha de emisión' ELSE 'el total' END), '; ')
    || CASE route WHEN 'NONE' THEN '. Revise los patrones del extractor o use otro formato.'
       ELSE '. Campos recuperables entregados para fusión híbrida.' END END AS message
FROM solved""")
sql("rule_table", f"""
WITH {TRUTH},
expected(field, rank, name, layouts) AS (VALUES
  ('number', 1, 'referencia_de_pago', ['0']),
  ('number', 2, 'factura_electronica_venta_no', ['1', '2', '4', '5', '6', '7b']),
  ('number', 3, 'generico_factura_no', ['1', '2', '4', '6', '7b']),
  ('number', 4, 'numero_prefijo_guion_linea', ['4']),
  ('number', 5, 'numero_solo_prefijo_no', ['3']),
  ('issue_date', 1, 'fecha_de_emision', ['1', '6', '7b']),
  ('issue_date', 2, 'fecha_de_expedicion', ['2']),
  ('issue_date', 3, 'fecha_de_validacion', []),
  ('issue_date', 4, 'periodo_de_facturacion', ['0']),
  ('issue_date', 5, 'fecha_de_factura', ['5']),
  ('issue_date', 6, 'fecha_de_generacion', []),
  ('due_date', 1, 'fecha_limite_de_pago', ['0']),
  ('due_date', 2, 'fecha_de_vencimiento', ['1']),
  ('due_date', 3, 'fecha_de_pago', ['2']),
  ('total', 1, 'total_a_pagar', ['0', '1', '7b']),
  ('total', 2, 'total_venta', []),
  ('total', 3, 'total_valor', ['2']),
  ('total', 4, 'total_simple', ['3', '4', '5', '7a']),
  ('subtotal', 1, 'subtotal', ['1', '3', '4']),
  ('tax', 1, 'monto_iva', ['1', '7b']),
  ('tax', 2, 'impuestos_iva_inline', ['0']),
  ('tax', 3, 'iva_etiqueta', ['0', '1', '7b']),
  ('items', 1, 'fila_estructurada', ['1'])),
per_layout AS (SELECT l, count(*) AS c FROM truth GROUP BY l)
SELECT field, rank, name, CAST(coalesce(sum(c), 0) AS BIGINT) AS documents
FROM expected LEFT JOIN per_layout ON list_contains(layouts, l) GROUP BY field, rank, name""")

# ------------------------------------------------------------ fusion and contract
sql("recover_llm_json", f"""
WITH {HEAD} {REPLIES}
SELECT invoice_id AS doc_id, outcome, CASE WHEN outcome = 'object' THEN r_number ELSE '' END AS number FROM wrapped""")
sql("contract_check", f"""
WITH {HEAD} {REPLIES}
SELECT invoice_id AS doc_id, r_number AS number, {n('r_issue')} AS issue_date, r_currency AS currency,
  1 AS n_items, violations, {v("violations = ''")} AS is_valid FROM payloads""")

STRINGS = """
strings AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, c, c // 100 AS w, c % 100 AS r, c % 10 AS d,
    (l_partkey + l_suppkey) % 12 AS style,
    format('{:,}', c // 100) AS us, replace(format('{:,}', c // 100), ',', '.') AS la,
    lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS rr
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)),
raws AS (
  SELECT *, CASE style WHEN 0 THEN '$' || us || '.' || rr WHEN 1 THEN 'COP ' || la || ',' || rr
    WHEN 2 THEN w || '.' || rr WHEN 3 THEN la WHEN 4 THEN us WHEN 5 THEN w || ',' || d
    WHEN 6 THEN w || '.' || rr || '.' WHEN 7 THEN '-' || w WHEN 8 THEN w || '.' || lpad(CAST(d AS VARCHAR), 2, '0') || '5'
    WHEN 9 THEN ' ' WHEN 10 THEN 'abc ' || w END AS raw
  FROM strings)
"""
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _number(text: str, scale: int) -> str:
    """Plain number text with at most three decimals to decimal text, else NULL."""
    return (f"CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') "
            f"THEN CAST(CAST({text} AS DECIMAL(30,{scale})) AS VARCHAR) END")


sql("parse_latam_amount", rf"""
WITH {STRINGS},
bare AS (SELECT *, replace(replace(replace(replace(trim(raw), '$', ''), ' ', ''), 'COP', ''), 'USD', '') AS t FROM raws),
plain AS (SELECT *, CASE
  WHEN contains(t, ',') AND contains(t, '.') THEN
    CASE WHEN instr(reverse(t), ',') < instr(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
  WHEN contains(t, ',') THEN CASE WHEN instr(reverse(t), ',') = 3
    THEN replace(left(t, length(t) - 3), ',', '') || '.' || right(t, 2) ELSE replace(t, ',', '') END
  WHEN contains(t, '.') AND instr(reverse(t), '.') >= 4 THEN replace(t, '.', '')
  ELSE t END AS p FROM bare)
SELECT {_KEYS}, coalesce({_number('p', 2)}, 'rejected') AS amount FROM plain""")
sql("coerce_contract_amount", rf"""
WITH {STRINGS},
plain AS (SELECT *, coalesce(nullif(replace(replace(trim(raw), ' ', ''), ',', '.'), ''), '0') AS p0 FROM raws),
checked AS (SELECT *, CASE WHEN raw IS NOT NULL THEN p0 END AS p FROM plain)
SELECT {_KEYS}, coalesce({_number("coalesce(p, '0')", 4)}, 'rejected') AS amount FROM checked""")
sql("money_normalize", rf"""
WITH {STRINGS},
bare AS (SELECT *, replace(trim(raw), ' ', '') AS t FROM raws),
plain AS (SELECT *, CASE
  WHEN contains(t, ',') AND contains(t, '.') THEN
    CASE WHEN instr(reverse(t), ',') < instr(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
  ELSE replace(t, ',', '.') END AS p FROM bare)
SELECT {_KEYS}, CASE WHEN raw IS NULL THEN '0.00'
  WHEN regexp_full_match(p, '([0-9]+\.?[0-9]*|\.[0-9]+)') THEN CAST(CAST(CAST(p AS DECIMAL(30,3)) AS DECIMAL(30,2)) AS VARCHAR)
  ELSE 'rejected' END AS amount FROM plain""")

sql("fuse_rules_fallback", f"""
WITH {TRUTH} {REPLIES},
f AS (SELECT kk, r_number, r_issue, due_date AS r_due, r_currency, r_total_c, supplier_id AS r_supplier
      FROM payloads WHERE violations = ''),
j AS (SELECT s.*, f.*, kk IS NOT NULL AND route = 'PARTIAL' AS merged,
        kk IS NOT NULL AND route IN ('NONE', 'NO_ITEMS') AS replaced
      FROM solved s LEFT JOIN f ON kk = doc_id)
SELECT doc_id,
  CASE WHEN replaced THEN 'fallback' WHEN merged THEN 'merged' WHEN route = 'FULL' THEN 'rules' ELSE route END AS outcome,
  CASE WHEN replaced THEN r_number ELSE {n('number')} END AS number,
  CASE WHEN replaced THEN {n('r_issue')} ELSE {n('issue_date')} END AS issue_date,
  CASE WHEN replaced OR merged THEN {n('r_due')} ELSE {n('due_date')} END AS due_date,
  CASE WHEN replaced OR merged THEN r_currency WHEN route = 'FULL' OR confident THEN currency ELSE '' END AS currency,
  CASE WHEN replaced OR merged THEN {n(m('r_total_c'))} ELSE {n(m('total_c'))} END AS total,
  CASE WHEN replaced OR (merged AND name IS NULL) THEN 'COMERCIAL ANDINA ' || r_supplier ELSE {n('name')} END AS supplier_name,
  CASE WHEN replaced OR merged THEN 1 WHEN l = '1' THEN n_items WHEN route = 'FULL' THEN 1 ELSE 0 END AS n_items,
  CASE WHEN replaced OR merged THEN 'fallback' WHEN total_c IS NOT NULL THEN 'rules' ELSE 'none' END AS money_from,
  CASE WHEN replaced OR merged THEN 'fallback' WHEN route = 'FULL' THEN 'rules' ELSE 'none' END AS items_from
FROM j""")
sql("fuse_two_sources", f"""
WITH {TRUTH},
w AS (SELECT *, k // 8 % 4 AS way,
        k // 8 % 4 = 2 AND l IN ('1', '2', '3', '4', '7a', '7b') AS cut FROM solved),
o AS (SELECT *, CASE
    WHEN way = 3 THEN 'NONE'
    WHEN cut AND l = '7a' THEN 'PARTIAL' WHEN cut THEN 'FULL'
    WHEN route IN ('NONE', 'NO_ITEMS') THEN 'NONE' ELSE route END AS outcome FROM w)
SELECT doc_id, outcome,
  CASE WHEN outcome = 'NONE' THEN '' WHEN l = '7a' THEN CAST(5000000000 + k AS VARCHAR) ELSE {n('number')} END AS number,
  CASE WHEN outcome = 'NONE' THEN '' ELSE {n('issue_date')} END AS issue_date,
  CASE WHEN outcome = 'NONE' THEN '' ELSE {n('due_date')} END AS due_date,
  CASE WHEN outcome = 'NONE' OR NOT confident THEN '' ELSE currency END AS currency,
  CASE WHEN outcome = 'NONE' THEN '' ELSE {n(m('total_c'))} END AS total,
  CASE WHEN outcome = 'NONE' THEN '' ELSE {n('name')} END AS supplier_name,
  CASE WHEN outcome <> 'FULL' THEN 0 WHEN l = '1' THEN n_items ELSE 1 END AS n_items,
  CASE WHEN outcome <> 'PARTIAL' THEN '' WHEN l = '7a' THEN 'supplier|issue_date' ELSE missing END AS missing_fields
FROM o""")

# -------------------------------------------------------------------- validation
sql("entity_invariants", f"""
WITH {INVOICES}
SELECT * FROM (
  SELECT 'invoice' AS kind, invoice_id AS id, concat_ws('|', CASE WHEN invoice_id % 23 = 0 THEN 'invoice.number' END,
    CASE WHEN invoice_id % 29 = 0 THEN 'invoice.currency' END,
    CASE WHEN invoice_id % 31 = 0 THEN 'invoice.total' END) AS faults FROM invoices
  UNION ALL
  SELECT 'supplier', s_suppkey, concat_ws('|', CASE WHEN s_suppkey % 5 = 0 THEN 'supplier.name' END,
    CASE WHEN s_suppkey % 7 = 0 THEN 'supplier.tax_id' END) FROM supplier
  UNION ALL
  SELECT 'document', doc_id, concat_ws('|', CASE WHEN n_chars - 100 < 0 THEN 'document.size_bytes' END,
    CASE WHEN coalesce(source, '') = '' THEN 'document.filename' END) FROM documents)
WHERE faults <> ''""")
sql("invoice_line_totals", f"""
WITH {ITEMS}
SELECT invoice_id, count(*) AS n_items, {m('sum(total_c)')} AS items_total, {m('sum(quantity * unit_c)')} AS net_total
FROM items GROUP BY invoice_id""")

_COLUMNS = "invoice_id, rule_ord, item, code, severity, message, field"
DATE_ISSUES = f"""
  SELECT invoice_id, 2 AS rule_ord, -1 AS item,
    CASE WHEN issue_date - {AS_OF} > 365 THEN 'date.issue_far_future' ELSE 'date.issue_future' END AS code,
    CASE WHEN issue_date - {AS_OF} > 365 THEN 'WARNING' ELSE 'INFO' END AS severity,
    'Issue date ' || issue_date || CASE WHEN issue_date - {AS_OF} > 365 THEN ' is more than one year ahead'
      ELSE ' lies in the future' END AS message, 'issue_date' AS field
  FROM invoices WHERE issue_date - {AS_OF} > 1
  UNION ALL
  SELECT invoice_id, 3, -1, 'date.due_before_issue', 'ERROR',
    'Due date ' || due_date || ' precedes issue date ' || issue_date, 'due_date'
  FROM invoices WHERE due_date < issue_date"""
QUANTITY_ISSUES = """
  SELECT invoice_id, 7 AS rule_ord, position AS item, 'range.item_quantity' AS code, 'ERROR' AS severity,
    'Item #' || (position + 1) || ' quantity must be positive' AS message, 'items[' || position || '].quantity' AS field
  FROM items WHERE quantity <= 0"""
TOTAL_ISSUES = f"""
  SELECT invoice_id, 8 AS rule_ord, -1 AS item, 'math.total_mismatch' AS code, 'ERROR' AS severity,
    'subtotal (' || {m('subtotal_c')} || ') + tax (' || {m('tax_c')} || ') != total (' || {m('total_c')}
      || ') [diff ' || {m('subtotal_c + tax_c - total_c')} || ']' AS message, 'total' AS field
  FROM invoices WHERE abs(subtotal_c + tax_c - total_c) > 500"""
SUM_ISSUES = f"""
  SELECT invoice_id, 10 AS rule_ord, -1 AS item, 'math.items_subtotal_mismatch' AS code,
    CASE WHEN abs(net_c - subtotal_c) > n_items THEN 'ERROR' ELSE 'WARNING' END AS severity,
    'Sum of line totals (' || {m('net_c')} || ') differs from subtotal (' || {m('subtotal_c')} || ')' AS message,
    'subtotal' AS field
  FROM invoices WHERE abs(net_c - subtotal_c) > 500"""
LINE_ISSUES = f"""
  SELECT invoice_id, 11 AS rule_ord, position AS item,
    CASE WHEN abs(gap) > 2 THEN 'math.item_line_mismatch' ELSE 'math.item_line_rounding' END AS code,
    CASE WHEN abs(gap) > 2 THEN 'ERROR' ELSE 'WARNING' END AS severity,
    CASE WHEN abs(gap) > 2 THEN 'Item #' || (position + 1) || ': quantity(' || quantity || '.000) x unit_price('
        || {m('unit_c')} || ') != line total (' || {m('total_c')} || ')'
      ELSE 'Item #' || (position + 1) || ': line total (' || {m('total_c')} || ') differs from quantity x unit_price ('
        || {m('quantity * unit_c')} || ') by rounding' END AS message,
    'items[' || position || '].total' AS field
  FROM (SELECT *, total_c - quantity * unit_c AS gap FROM items) WHERE gap <> 0"""
ISSUES = f"""{INVOICES},
issues AS ({DATE_ISSUES} UNION ALL {QUANTITY_ISSUES} UNION ALL {TOTAL_ISSUES} UNION ALL {SUM_ISSUES} UNION ALL {LINE_ISSUES})
"""
sql("validate_dates", f"WITH {INVOICES} {DATE_ISSUES}")
sql("validate_ranges", f"""
WITH {INVOICES}
  SELECT invoice_id, 1 AS rule_ord, -1 AS item, 'required.number' AS code, 'ERROR' AS severity,
    'Invoice number is missing' AS message, 'number' AS field FROM invoices WHERE invoice_id % 23 = 0
  UNION ALL SELECT invoice_id, 4, -1, 'range.subtotal_negative', 'ERROR', 'Subtotal cannot be negative', 'subtotal'
    FROM invoices WHERE invoice_id % 29 = 0 AND subtotal_c > 0
  UNION ALL SELECT invoice_id, 5, -1, 'range.tax_negative', 'ERROR', 'Tax cannot be negative', 'tax'
    FROM invoices WHERE invoice_id % 31 = 0 AND tax_c < 100
  UNION ALL SELECT invoice_id, 6, -1, 'range.total_positive', 'ERROR', 'Total must be greater than zero', 'total'
    FROM invoices WHERE invoice_id % 37 = 0
  UNION ALL {QUANTITY_ISSUES}""")
sql("validate_total", f"WITH {INVOICES} {TOTAL_ISSUES}")
sql("validate_items_sum", f"WITH {INVOICES} {SUM_ISSUES}")
sql("validate_lines", f"WITH {ITEMS} {LINE_ISSUES}")
sql("validation_report", f"""
WITH {ISSUES}
SELECT i.invoice_id, {v("count(*) FILTER (WHERE severity = 'ERROR') OVER (PARTITION BY i.invoice_id) = 0")} AS is_valid,
  {n('rule_ord')} AS rule_ord, {n('item')} AS item, {n('code')} AS code, {n('severity')} AS severity,
  {n('message')} AS message, {n('field')} AS field
FROM invoices i LEFT JOIN issues s ON i.invoice_id = s.invoice_id""")
sql("issue_summary", f"WITH {ISSUES} SELECT severity, code, count(*) AS n_issues FROM issues GROUP BY severity, code")

# ------------------------------------------------------------------- persistence
sql("supplier_dedup", f"""
WITH {HEAD},
ranked AS (SELECT invoice_id, supplier_id, CAST(900000000 + supplier_id % 40 AS VARCHAR) AS tax_id,
  row_number() OVER (PARTITION BY supplier_id % 40 ORDER BY created_at, invoice_id) AS rn FROM head)
SELECT tax_id, 'COMERCIAL ANDINA ' || supplier_id AS name, 'CALLE ' || (supplier_id % 100) AS address,
  invoice_id AS first_doc_id
FROM ranked WHERE rn = 1 AND tax_id NOT IN
  (SELECT CAST(900000000 + s_suppkey % 40 AS VARCHAR) FROM supplier WHERE s_suppkey % 40 = 3)""")
sql("duplicate_invoice_reject", f"""
WITH {INVOICES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY supplier_id, number ORDER BY document_id % 4 <> 0, created_at, invoice_id) AS rn FROM invoices)
SELECT invoice_id, supplier_id, number, CASE WHEN rn = 1 THEN 'kept' ELSE 'rejected' END AS outcome,
  CASE WHEN rn = 1 THEN '' ELSE 'persistence_error' END AS code, 'false' AS retryable FROM ranked""")
sql("process_once", f"""
WITH {INVOICES}, {JOBS}
SELECT job_id, j.document_id, {n('invoice_id')} AS stored_invoice_id,
  CASE WHEN status = 'COMPLETED' THEN 'skip' WHEN j.document_id NOT IN (SELECT l_orderkey FROM lineitem) THEN 'document_not_found'
    WHEN invoice_id IS NOT NULL AND status = 'FAILED' THEN 'refuse'
    WHEN invoice_id IS NOT NULL THEN 'resume' ELSE 'process' END AS action
FROM jobs j LEFT JOIN (SELECT * FROM invoices WHERE document_id % 2 = 0) i ON j.document_id = i.document_id""")
sql("build_invoice_tables", f"""
WITH {HEAD} {REPLIES}, good AS (SELECT * FROM payloads WHERE violations = '')
SELECT 'invoice' AS kind, invoice_id AS document_id, 0 AS position,
  CAST(supplier_id AS VARCHAR) || '|' || r_number || '|' || r_issue || '|' || r_currency AS what,
  {m('net_c')} AS subtotal, {m('r_tax_c')} AS tax_amount, {m('r_total_c')} AS total FROM good
UNION ALL
SELECT 'item', invoice_id, 0, CASE WHEN kk % 3 <> 0 THEN 'Servicio' ELSE 'Conceptos facturados (agregado del documento)' END || '|1.000',
  {m('net_c')}, {m('CASE WHEN kk % 3 <> 0 THEN tax_c ELSE r_tax_c END')}, {m('net_c')} FROM good""")
sql("audit_payload", f"""
WITH {HEAD} {REPLIES}
SELECT invoice_id AS doc_id, r_number AS number, {v('r_issue')} AS issue_date, coalesce({v('due_date')}, 'null') AS due_date,
  {m('r_total_c')} AS total, CAST(900000000 + supplier_id AS VARCHAR) AS tax_id, {m('net_c')} AS first_item_total
FROM payloads WHERE violations = ''""")

# ----------------------------------------------------------- queries, aggregates
LISTED = f"""
  invoice_id, document_id, number, {v('issue_date')} AS issue_date, {n('due_date')} AS due_date, currency,
  {m('subtotal_c')} AS subtotal, {m('tax_c')} AS tax_amount, {m('total_c')} AS total,
  {n('name')} AS supplier_name, {n('tax_id')} AS supplier_tax_id
FROM invoices LEFT JOIN suppliers USING (supplier_id)"""
sql("invoice_search", f"""
WITH {INVOICES} {SUPPLIERS}
SELECT {LISTED} WHERE number ILIKE '%ndina _ s.a%' OR name ILIKE '%ndina _ s.a%' OR tax_id ILIKE '%ndina _ s.a%'""")
sql("invoice_date_range", f"""
WITH {INVOICES} {SUPPLIERS}
SELECT {LISTED} WHERE issue_date BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'""")
sql("invoice_page", f"""
WITH {INVOICES} {SUPPLIERS},
found AS (SELECT * FROM invoices LEFT JOIN suppliers USING (supplier_id) WHERE name ILIKE '%andina%')
SELECT invoice_id, number, {v('issue_date')} AS issue_date, name AS supplier_name, {m('total_c')} AS total,
  (SELECT count(*) FROM found) AS total_count
FROM found f ORDER BY f.issue_date DESC, created_at DESC, invoice_id DESC LIMIT 20 OFFSET 1000""")
sql("invoice_detail", f"""
WITH {INVOICES} {SUPPLIERS},
lined AS (SELECT invoice_id, position, 'ARTICULO ' || part_id AS description, quantity || '.000' AS quantity,
  {m('unit_c')} AS unit_price, {m('tax_c')} AS item_tax, {m('total_c')} AS item_total FROM items)
SELECT invoice_id, document_id, number, {v('issue_date')} AS issue_date, {n('due_date')} AS due_date, currency,
  {m('subtotal_c')} AS subtotal, {m('tax_c')} AS tax_amount, {m('total_c')} AS total,
  coalesce(name, '(unknown)') AS supplier_name, {n('tax_id')} AS supplier_tax_id, {n('address')} AS address,
  {n('phone')} AS phone, {n('email')} AS email,
  position, description, quantity, unit_price, item_tax, item_total
FROM invoices LEFT JOIN suppliers USING (supplier_id) LEFT JOIN lined USING (invoice_id)""")
sql("invoice_stats", f"""
WITH {INVOICES} SELECT count(*) AS total_invoices, {m('coalesce(sum(total_c), 0)')} AS total_invoiced FROM invoices""")
sql("job_counts", f"WITH {JOBS} SELECT status, count(*) AS n_jobs FROM jobs GROUP BY status")
sql("dashboard", f"""
WITH {INVOICES}, {JOBS}
SELECT count_if(status = 'PENDING') AS pending_jobs, count_if(status = 'PROCESSING') AS processing_jobs,
  count_if(status = 'COMPLETED') AS completed_jobs, count_if(status = 'FAILED') AS failed_jobs,
  (SELECT count(*) FROM invoices) AS total_invoices,
  (SELECT {m('coalesce(sum(total_c), 0)')} FROM invoices) AS total_invoiced
FROM jobs""")
sql("job_status", f"""
WITH {JOBS}
SELECT job_id, document_id, status, attempts, {n('seconds')} AS duration_seconds,
  {v("status IN ('COMPLETED', 'FAILED')")} AS is_terminal FROM jobs""")
sql("failure_reasons", f"""
WITH {JOBS},
parts AS (SELECT unnest(string_split(coalesce(error_message, 'unknown error'), '; ')) AS p FROM jobs WHERE status = 'FAILED')
SELECT trim(p, ' .') AS reason, count(*) AS n_jobs FROM parts WHERE trim(p) <> '' GROUP BY 1""")

# ------------------------------------------------------------------------ jobs
def _fold(moves: dict[str, dict[int, int]]) -> str:
    cases = " ".join(
        f"WHEN g.kind = '{kind}' AND f.state = {before} THEN {after}"
        for kind, table in moves.items() for before, after in table.items()
    )
    return f"""
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS rn, 0 AS state, 0 AS starts, 0 AS illegal, CAST(NULL AS TIMESTAMP) AS first_started,
    CAST(NULL AS TIMESTAMP) AS last_finished, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS BIGINT) AS invoice_id
  FROM (SELECT DISTINCT job_id FROM log)
  UNION ALL
  SELECT job_id, rn, coalesce(nxt, state), starts + if(legal AND kind = 'start', 1, 0),
    illegal + if(NOT legal AND kind IN ('start', 'complete', 'fail'), 1, 0),
    coalesce(first_started, if(legal AND kind = 'start', ts, NULL)),
    if(legal AND kind IN ('complete', 'fail'), ts, last_finished),
    if(legal AND kind = 'fail', 'failed at ' || event_id, message),
    coalesce(if(legal AND kind = 'complete', event_id, NULL), invoice_id)
  FROM (SELECT f.job_id, g.rn, f.state, f.starts, f.illegal, f.first_started, f.last_finished, f.message, f.invoice_id,
          g.kind, g.ts, g.event_id, CASE {cases} END AS nxt, (CASE {cases} END) IS NOT NULL AS legal
        FROM fold f JOIN log g ON g.job_id = f.job_id AND g.rn = f.rn + 1)),
final AS (SELECT f.* FROM fold f JOIN (SELECT job_id, max(rn) AS rn FROM log GROUP BY job_id) USING (job_id, rn))
"""


_JOB_FOLD = _fold({"start": {0: 1, 1: 1, 3: 1}, "complete": {0: 2, 1: 2, 2: 2}, "fail": {0: 3, 1: 3, 2: 3, 3: 3}})
_DOCUMENT_FOLD = _fold({"start": {0: 1, 1: 1}, "complete": {1: 2}, "fail": {0: 3, 1: 3, 3: 3}})
_JOB_STATE = "['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED'][state + 1]"
sql("job_state_fold", f"""
WITH RECURSIVE {EVENTS}, {_JOB_FOLD}
SELECT job_id, {_JOB_STATE} AS status, starts AS attempts, illegal AS illegal_events,
  coalesce({ts('first_started')}, '') AS started_at, coalesce({ts('last_finished')}, '') AS finished_at,
  {n('message')} AS error_message, {n('invoice_id')} AS invoice_id FROM final""")
sql("stream_job_state", f"""
WITH RECURSIVE {EVENTS}, {_JOB_FOLD}
SELECT job_id, {_JOB_STATE} AS status, starts AS attempts, illegal AS illegal_events FROM final""")
sql("document_state_fold", f"""
WITH RECURSIVE {EVENTS}, {_DOCUMENT_FOLD}
SELECT job_id AS document_id, ['RECEIVED', 'PROCESSING', 'PROCESSED', 'FAILED'][state + 1] AS status,
  illegal AS illegal_events FROM final""")
sql("failure_disposition", """
WITH f AS (
  SELECT event_id, ['ocr_extraction_failed', 'llm_extraction_failed', 'storage_error', 'invalid_file',
      'llm_extraction_partial', 'document_processing_failed', 'persistence_error'][event_id % 7 + 1] AS code,
    CAST(user_id % 5 AS INTEGER) AS retries, event_id % 29 = 0 AS timed_out,
    event_id % 11 <> 6 AND event_id % 7 IN (0, 1, 2, 6) AS retry
  FROM events WHERE event_type IN ('error', 'click')),
g AS (SELECT *, retry AND retries < 3 AND NOT timed_out AS again FROM f)
SELECT event_id, code, retries, CASE WHEN again THEN 'RETRY' ELSE 'FAILED' END AS disposition,
  CASE WHEN timed_out THEN 'timeout' WHEN again THEN '' WHEN retry THEN 'retries_exhausted' ELSE code END AS reason,
  CASE WHEN again THEN CAST(30 * power(2, retries) AS BIGINT) ELSE 0 END AS retry_in_seconds FROM g""")
sql("stream_process_once", f"""
WITH {TRUTH},
gaps AS (SELECT invoice_id, abs(total_c - greatest(quantity, 1) * unit_c) AS gap FROM items WHERE invoice_id % 8 = 1),
lines_off AS (SELECT invoice_id, count(*) AS n_off, count(*) FILTER (WHERE gap > 2) AS n_bad FROM gaps WHERE gap > 0 GROUP BY invoice_id),
good AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY tax_id ORDER BY doc_id % 2, doc_id) AS ledger_supplier
  FROM solved WHERE route = 'FULL'),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY ledger_supplier, number ORDER BY doc_id % 2, doc_id) = 1 AS first FROM good),
told AS (
  SELECT o_orderkey AS document_id, coalesce(k.first, false) AS stored, k.*, coalesce(n_off, 0) AS off, coalesce(n_bad, 0) AS bad,
    CASE WHEN s.doc_id IS NULL THEN 'document_not_found' WHEN k.first THEN '' WHEN k.doc_id IS NOT NULL THEN 'persistence_error'
      WHEN s.route = 'PARTIAL' THEN 'llm_extraction_partial' ELSE 'llm_extraction_failed' END AS code
  FROM orders LEFT JOIN solved s ON s.doc_id = o_orderkey LEFT JOIN kept k ON k.doc_id = o_orderkey
  LEFT JOIN lines_off ON lines_off.invoice_id = o_orderkey)
SELECT document_id, if(stored, 'PROCESSED', 'FAILED') AS status, if(stored, 'COMPLETED', 'FAILED') AS job_status, code,
  {n("CASE WHEN stored THEN ledger_supplier END")} AS supplier_id, {n("CASE WHEN stored THEN tax_id END")} AS tax_id,
  {n("CASE WHEN stored THEN number END")} AS number, {n("CASE WHEN stored THEN " + m('total_c') + " END")} AS total,
  {n("CASE WHEN stored THEN if(l = '1', n_items, 1) END")} AS n_items,
  {n("CASE WHEN stored THEN " + m("if(l = '1', net_c, sub_c)") + " END")} AS items_total,
  {n("CASE WHEN stored THEN if(bad = 0, 'true', 'false') END")} AS is_valid,
  {n(f"CASE WHEN stored THEN off + if(issue_date - {AS_OF} > 1, 1, 0) END")} AS n_issues
FROM told""")
sql("stream_job_counts", f"""
WITH RECURSIVE {EVENTS}, {_JOB_FOLD}
SELECT {_JOB_STATE} AS status, count(*) AS n_jobs FROM final GROUP BY 1""")
