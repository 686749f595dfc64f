"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, quality, toxicity
from ledgerloom.llm.collisions import nearest
from ledgerloom.llm.common import ship, table
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.jaccard import jaccard_join
from ledgerloom.llm.lexical import lexical_search
from ledgerloom.llm.line_dedup import line_dedup
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.phrases import collocations
from ledgerloom.llm.suffix_dedup import suffix_dedup
from ledgerloom.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), runs=True)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out(folds=4, fold=2)
    scored = toxicity.toxicity(docs, labels, ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.bpe_round_trip(table(spark, sf_dir, "documents"), path, pattern))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = docs.select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(fold.filter("not held_out"))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op10_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 well made but toxic, 2 well made; kept are documents likelier above 0 than not.

    Rows of the fold crc32(doc_id) mod 5 = 0 keep their ratings from the fit.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out()
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    model = quality.train(docs, labels.filter(~out).select("doc_id", grade.alias("grade")))
    rated = quality.rate(docs, model)
    return rated.select(
        "doc_id", out.alias("held_out"), "expected_grade",
        F.element_at("tails", 1).alias("p_above_0"), F.element_at("tails", -1).alias("p_top"),
        (F.element_at("tails", 1) >= 0.5).alias("kept"),
    )


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLES["op8_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, text_sha256
FROM d
"""

ORACLES["op3_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id AND q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_collocations"] = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER_AZ}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, f AS a, p, array_to_string(w[1:p], ' ') AS head, array_to_string(w[p + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS p FROM c)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.p, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, p) = 1
), held AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2))
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM weakest s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM ranked k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""

_TERMS = f"regexp_extract_all({_LOWER_AZ}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES["op12_lexical_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), known AS (
  SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM known
), tf AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM known) GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs
), sized AS (
  SELECT r, doc_id, 100 - 50 + (50 * n * docs) // words AS m FROM known, whole
), asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL
), scored AS (
  SELECT a.item_id, s.r, s.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * s.m))) AS BIGINT) AS score
  FROM asked a JOIN tf t ON t.term = a.term JOIN weight w ON w.term = a.term JOIN sized s ON s.r = t.r
  GROUP BY a.item_id, s.r, s.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
