"""File audit, registration and page assembly over tables of files and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.binding import settle
from ledgerloom.functions.text import safe_filename, trim_blank

# Limits, formats and signatures.
MAX_BYTES = 10 * 1024 * 1024
PDF_WINDOW = 1024
PDF_MARK = b"%PDF-"
PNG_MARK = b"\x89PNG\r\n\x1a\n"
JPEG_MARK = b"\xff\xd8\xff"
EXTENSIONS = ("pdf", "png", "jpg", "jpeg")
PDF_MIME = "application/pdf"
IMAGE_MIMES = ("image/png", "image/jpeg", "image/jpg")
DEFAULT_MIME = {"PDF": "application/pdf", "PNG": "image/png", "JPEG": "image/jpeg"}
MIN_PAGE_CHARS = 40
# Pages joined in one step; a document's steps are joined in turn.
PAGES_A_STEP = 500


def signature(content: Column, pdf_window: int = PDF_WINDOW) -> Column:
    """PDF, PNG or JPEG by magic bytes (PDF anywhere in the format's window), else NULL."""
    return (
        F.when(F.contains(F.substring(content, 1, pdf_window), F.lit(PDF_MARK)), F.lit("PDF"))
        .when(F.startswith(content, F.lit(PNG_MARK)), F.lit("PNG"))
        .when(F.startswith(content, F.lit(JPEG_MARK)), F.lit("JPEG"))
    )


def _family(kind: Column) -> Column:
    return F.when(kind == "PDF", F.lit("PDF")).when(kind.isNotNull(), F.lit("IMAGE"))


def _default_mime(kind: Column) -> Column:
    mime = F.lit(None).cast("string")
    for name, value in DEFAULT_MIME.items():
        mime = F.when(kind == name, F.lit(value)).otherwise(mime)
    return mime


def sniff(files: DataFrame) -> DataFrame:
    """Format, family and default MIME type of every file's content."""
    kind = F.col("format")
    return files.withColumn("format", signature(F.col("content"))).select(
        "doc_id", "format", _family(kind).alias("document_type"), _default_mime(kind).alias("mime_type")
    )


def audit_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Accept or reject each file; the first broken rule gives the error.

    Reads ``filename``, ``declared_mime`` and ``content``; adds ``error_code``
    and ``reason`` (NULL when accepted), ``format``, ``document_type``,
    ``mime_type`` and ``size_bytes``.
    """
    c = F.col
    dotted = c("filename").contains(".")
    extension = F.when(dotted, F.lower(F.substring_index("filename", ".", -1))).otherwise(F.lit(""))
    mime = trim_blank(F.split_part(F.coalesce("declared_mime", F.lit("")), F.lit(";"), F.lit(1)))
    declared = F.when(c("mime") == PDF_MIME, F.lit("PDF")).otherwise(F.lit("IMAGE"))
    expected = F.when(c("extension") == "pdf", F.lit("PDF")).otherwise(F.lit("IMAGE"))
    checked = (
        files.withColumn("size_bytes", F.octet_length("content").cast("long"))
        .withColumn("extension", extension)
        .withColumn("mime", F.lower(mime))
        .withColumn("format", signature(c("content")))
        .drop("content")
    )
    checked = settle(checked).withColumn("family", _family(c("format")))
    reason = (
        F.when(c("size_bytes") > max_bytes, F.lit("too_large"))
        .when(c("size_bytes") == 0, F.lit("empty"))
        .when(~c("extension").isin(*EXTENSIONS), F.lit("extension"))
        .when((c("mime") != "") & ~c("mime").isin(PDF_MIME, *IMAGE_MIMES), F.lit("mime"))
        .when(c("format").isNull(), F.lit("signature"))
        .when(c("family") != expected, F.lit("family"))
        .when((c("mime") != "") & (c("family") != declared), F.lit("mime_content"))
    )
    code = (
        F.when(c("reason") == "too_large", F.lit("file_too_large"))
        .when(c("reason") == "empty", F.lit("empty_file"))
        .when(c("reason").isNotNull(), F.lit("invalid_file"))
    )
    return (
        settle(checked.withColumn("reason", reason))
        .withColumn("error_code", code)
        .withColumn("document_type", F.when(c("reason").isNull(), c("family")))
        .withColumn("mime_type", F.when(
            c("reason").isNull(),
            F.when(c("mime") == "", _default_mime(c("format"))).otherwise(c("mime")),
        ))
        .drop("family", "mime")
    )


def storage_key(doc_id: Column, filename: Column, stored_at: Column, name_chars: int | None = None) -> Column:
    """``YYYY/MM/<doc>__<name>``; ``name_chars`` cuts the name where a file system asks for it."""
    name = F.regexp_replace(safe_filename(filename), "[^A-Za-z0-9._-]", "_")
    if name_chars is not None:
        name = F.left(name, F.lit(name_chars))
    return F.concat(F.date_format(stored_at, "yyyy/MM"), F.lit("/"), doc_id.cast("string"), F.lit("__"), name)


def register_documents(audited: DataFrame) -> DataFrame:
    """``documents`` rows (RECEIVED) of the accepted files; needs ``received_at``."""
    return audited.filter("error_code IS NULL").select(
        F.col("doc_id").alias("document_id"),
        safe_filename(F.col("filename")).alias("filename"),
        F.col("mime_type").alias("content_type"),
        "size_bytes",
        storage_key(F.col("doc_id"), F.col("filename"), F.col("received_at")).alias("storage_path"),
        "document_type",
        F.lit("RECEIVED").alias("status"),
        F.col("received_at").alias("created_at"),
    )


def register_jobs(documents: DataFrame) -> DataFrame:
    """One PENDING job without attempts per registered document."""
    return documents.select(
        F.col("document_id").alias("job_id"), "document_id",
        F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), "created_at",
    )


def assemble_pages(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS, documents: DataFrame | None = None) -> DataFrame:
    """Document text from its pages: embedded text where there is enough, else OCR; one row a document.

    Pages are joined in steps of neighbouring pages first, so that no task sorts all pages of a
    document, then the steps' texts in order. With ``documents`` (doc_id), those without a page come
    out as method ``empty`` with 0 pages.
    """
    embedded, ocr = trim_blank(F.coalesce("embedded_text", F.lit(""))), trim_blank(F.coalesce("ocr_text", F.lit("")))
    enough = F.length("embedded") >= min_chars
    chosen = pages.withColumn("embedded", embedded).select(
        "doc_id", "page_no",
        F.when(enough, F.col("embedded")).otherwise(
            F.coalesce(F.nullif(ocr, F.lit("")), F.col("embedded"))).alias("text"),
        enough.alias("is_embedded"),
    )

    def joined(items: str, order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, items))), lambda p: p[items]), "\n\n")

    steps = (
        chosen.withColumn("step", F.floor(F.col("page_no") / PAGES_A_STEP).cast("int"))
        .groupBy("doc_id", "step")
        .agg(joined("text", "page_no").alias("text"), F.count("*").alias("n"), F.count_if("is_embedded").alias("n_embedded"))
    )
    whole = steps.groupBy("doc_id").agg(
        joined("text", "step").alias("text"), F.sum("n").alias("page_count"), F.sum("n_embedded").alias("e")
    )
    if documents is not None:
        whole = documents.select("doc_id").join(whole, "doc_id", "left").na.fill({"text": "", "page_count": 0, "e": 0})
    n_ocr = F.col("page_count") - F.col("e")
    label = F.concat(
        F.array_join(F.array_compact(F.array(
            F.when(F.col("e") > 0, F.lit("embedded-text")), F.when(n_ocr > 0, F.lit("tesseract")))), "+"),
        F.when(n_ocr > 0, F.concat(F.lit(" (ocr_pages="), n_ocr.cast("string"), F.lit(")"))).otherwise(F.lit("")),
    )
    method = F.when(F.col("page_count") == 0, F.lit("empty")).otherwise(label)
    return whole.select("doc_id", "text", "page_count", method.alias("method"))
