"""Recovering one JSON object from free-form model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.binding import found, let, settle
from ledgerloom.functions.text import trim_blank
from ledgerloom.schemas import PAYLOAD_DDL

# Fixed value: a reply that is one fenced block.
FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
# From the first opening to the last closing brace; anchored and possessive, so one pass whatever the text.
OUTER_BRACES = r"(?s)^[^{]*+(\{.*\})"


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def recover_json(replies: DataFrame) -> DataFrame:
    """Add ``json`` (the recovered object or NULL) and ``outcome``.

    An empty content falls back to ``reasoning``; a fence is stripped; text
    that is not JSON is cut from its first ``{`` to its last ``}``. Outcomes:
    ``object``, ``not_object`` (valid JSON of another kind) and ``malformed``.
    """
    content = F.coalesce("content", F.lit(""))
    chosen = F.when(trim_blank(content) == "", F.coalesce("reasoning", F.lit(""))).otherwise(content)
    text = trim_blank(chosen)
    bare = F.when(F.col("reply").rlike(FENCE), F.regexp_extract("reply", FENCE, 1)).otherwise(F.col("reply"))
    body = F.col("body")

    cut = found(body, OUTER_BRACES)
    read = replies.withColumn("reply", text).withColumn("body", bare)
    tried = settle(read).withColumn(
        "body", F.when(_is_json(body), body).otherwise(let(cut, lambda t: F.when(_is_json(t), t)))
    )
    return (
        settle(tried)
        .withColumn("outcome", F.when(body.isNull(), F.lit("malformed"))
                    .when(F.startswith(F.ltrim(body), F.lit("{")), F.lit("object"))
                    .otherwise(F.lit("not_object")))
        .withColumn("json", F.when(F.col("outcome") == "object", body))
        .drop("reply", "body")
    )


def payloads(recovered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recovered objects read with the payload schema (unknown keys drop out)."""
    return recovered.filter("outcome = 'object'").select(
        key, F.from_json("json", PAYLOAD_DDL).alias("p")
    ).transform(settle).select(key, "p.*")
