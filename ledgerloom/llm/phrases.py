"""Phrase collocation mining by Toivonen's method.

A sample of the documents proposes phrases that may be frequent. One full pass then counts, exactly and in
all documents, the proposed phrases and their negative border: phrases that were not proposed although what
is left of them without their first or last word was. If a border phrase turns out frequent, the proposals
were too few, and an expansion pass counts what they kept from being counted. From exact counts of all
frequent phrases follow the scores of their cuts.

Proposals only steer what is counted. They are sent to tasks as one bit map of fixed size: a bit set by
chance adds phrases that are counted, it never changes a count. Phrases themselves are counted by their
text, so no two are ever taken for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Stage, lean
from ledgerloom.llm.wordscan import BREAK, GAP, scan, slices, then, word_hashes

#: Words of a phrase at most.
LONGEST = 4
#: One document in so many is in the sample; a phrase is proposed with LOWERED of the support expected there.
SAMPLE, LOWERED = 8, 0.5
#: Bits of the map of proposals: 8 MB however many phrases there are.
BITS = 1 << 26
_BUCKET = 1 << 15

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
_COUNTS = "lang string, n int, phrase string, f long"


@dataclass
class Grams:
    """The different phrases of some length in one slice of texts, and where they begin (-1: not looked at)."""

    at: np.ndarray
    text: pa.Array
    hash: np.ndarray
    #: Whether the full pass counts the phrase, and whether longer phrases with it are worth counting.
    counted: np.ndarray
    extends: np.ndarray


def _seen(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes % np.uint64(BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _levels(texts: pa.Array, seed: np.uint64, extends: Callable[[Grams], np.ndarray], proposed, longest: int) -> Iterator[tuple[Grams, np.ndarray]]:
    """Phrases of 1, 2, ... words with their numbers in these texts; of longer ones only those whose two parts extend."""
    words, _, run = scan(texts, _KIND)
    coded = words.dictionary_encode()
    last = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = coded.dictionary
    own = word_hashes(vocabulary)
    grams = Grams(last, vocabulary, then(np.full(len(vocabulary), seed), own), np.ones(len(vocabulary), bool), np.empty(0, bool))
    for n in range(1, longest + 1):
        grams.extends = extends(grams)
        yield grams, np.bincount(grams.at[grams.at >= 0], minlength=len(grams.text))
        if n == longest or len(grams.at) < 2:
            return
        at, ahead = grams.at[:-1], grams.at[1:]
        fits = (at >= 0) & (ahead >= 0) & (run[:len(at)] == run[n:])
        where = np.flatnonzero(fits)
        where = where[grams.extends[at[where]] & grams.extends[ahead[where]]]
        coded = pa.array(at[where] * len(vocabulary) + last[where + n]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        both = coded.dictionary.to_numpy(zero_copy_only=False)
        left, right = both // max(len(vocabulary), 1), both % max(len(vocabulary), 1)
        any_place = np.zeros(len(both), dtype=np.int64)
        any_place[code] = where
        rest = grams.at[any_place + 1]
        found = np.full(len(at), -1, dtype=np.int64)
        found[where] = code
        part = proposed(grams.hash) & grams.counted
        grams = Grams(
            found, pc.binary_join_element_wise(grams.text.take(pa.array(left)), vocabulary.take(pa.array(right)), pa.scalar(" ", pa.large_string())),
            then(grams.hash[left], own[right]), part[left] & part[rest], np.empty(0, bool),
        )


def _seed(lang: str) -> np.uint64:
    return word_hashes(pa.array([lang]))[0]


def _count(maps, rule: str, only: int = 0):
    """Rows (lang, n, phrase, f) of each slice; n = 0 is the number of words.

    ``propose``: phrases of ``only`` words whose parts were proposed. ``full``: proposed phrases and their
    border. ``expand``: what the full pass did not count though no part that it counted is infrequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = maps.value
        proposed = lambda h: _seen(bits, h)

        def extends(g: Grams) -> np.ndarray:
            return _seen(frequent, g.hash) | ~g.counted if rule == "expand" else proposed(g.hash)

        for batch in batches:
            for part in slices(batch):
                for lang in pc.unique(part.column("lang")).to_pylist():
                    texts = part.column("text").filter(pc.equal(part.column("lang"), lang))
                    for n, (g, f) in enumerate(_levels(texts, _seed(lang), extends, proposed, only or LONGEST), 1):
                        if rule == "full" and n == 1:
                            yield _rows(lang, 0, pa.array([""]), np.array([f.sum()]))
                        if only in (0, n):
                            keep = np.flatnonzero(~g.counted if rule == "expand" else f > 0)
                            yield _rows(lang, n, g.text.take(pa.array(keep)), f[keep])

    return lean(run)


def _rows(lang: str, n: int, text: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(text), pa.string()), pa.array(np.full(len(text), n, np.int32)), text.cast(pa.string()), pa.array(f.astype(np.int64))],
        ["lang", "n", "phrase", "f"],
    )


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of rows (lang, n, phrase), as tasks compute them from texts."""
    out = np.zeros(batch.num_rows, dtype=np.uint64)
    langs, lengths = batch.column("lang"), batch.column("n").to_numpy(zero_copy_only=False)
    for lang in pc.unique(langs).to_pylist():
        for n in range(1, LONGEST + 1):
            rows = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False) & (lengths == n))
            if len(rows):
                words = pc.list_flatten(pc.split_pattern(batch.column("phrase").take(pa.array(rows)), " "))
                each = word_hashes(words).reshape(-1, n)
                h = then(np.full(len(rows), _seed(lang)), each[:, 0])
                for k in range(1, n):
                    h = then(h, each[:, k])
                out[rows] = h
    return out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.unique((phrase_hashes(batch) % np.uint64(BITS)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(slots // _BUCKET), pa.array(slots % _BUCKET)], ["bucket", "bit"])


def _map_of(phrases: DataFrame) -> np.ndarray:
    """The bit map of phrases that may be part of longer ones."""
    pieces = (
        phrases.filter(F.col("n").between(1, LONGEST - 1)).select("lang", "n", "phrase")
        .mapInArrow(lean(_slots), "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in pieces.collect():  # at most BITS / _BUCKET rows of 4 KB
        at = row["bucket"] * _BUCKET // 8
        out[at:at + _BUCKET // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def _unproposed(maps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_seen(maps.value[0], phrase_hashes(batch))))

    return run


def frequent_phrases(texts: DataFrame, support: int = 30, sample: int = SAMPLE) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of 1 to LONGEST words with f >= support; n = 0 has the number of words.

    ``texts`` has lang and text without nulls, and ``_pick``, a hash that deals rows into samples.
    """
    spark = texts.sparkSession
    none = np.zeros(BITS // 8, dtype=np.uint8)

    def counted(rows: DataFrame, bits: np.ndarray, frequent: np.ndarray, least: int, rule: str, only: int = 0) -> Stage:
        maps = spark.sparkContext.broadcast((bits, frequent))
        slice_counts = rows.select("lang", "text").mapInArrow(_count(maps, rule, only), _COUNTS)
        totals = slice_counts.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
        return Stage(totals.filter((F.col("n") == 0) | (F.col("f") >= least)), f"phrases-{rule}")

    some = texts.filter(F.pmod("_pick", F.lit(sample)) == 0)
    least = max(1, int(np.ceil(LOWERED * support / sample)))
    bits = none
    for n in range(1, LONGEST):
        proposals = counted(some, bits, none, least, "propose", n)
        bits = bits | _map_of(proposals.df)
        proposals.drop()
    full = counted(texts, bits, none, support, "full").df
    maps = spark.sparkContext.broadcast((bits, none))
    failed = full.filter(F.col("n").between(1, LONGEST - 1)).mapInArrow(_unproposed(maps), _COUNTS)
    if failed.isEmpty():
        return full
    # A frequent phrase that is not counted yet has no infrequent part among those counted. So this pass
    # counts every one of them, of all lengths at once, and no border is left that could fail.
    return full.unionByName(counted(texts, bits, _map_of(full), support, "expand").df)


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 * a / both), exact beyond 64 bits."""
    wide = (F.lit(2000000).cast("decimal(8,0)") * a.cast("decimal(20,0)")).cast("decimal(30,0)")
    return F.call_function("div", wide, both.cast("decimal(30,0)"))


def collocations(docs: DataFrame, support: int = 30, covered: int = 80, best: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    A phrase is 2 to LONGEST words in a row of one piece of a text; texts are split at ``.,;:!?`` and line ends
    into pieces, those at blanks and tabs into words; only A-Z are lower-cased. a is its number of occurrences
    (at least ``support``), l and r those of the two parts of its weakest cut, n all words of the language. A
    phrase goes if a longer frequent one holds it and has ``covered`` percent of its occurrences.

    A null text has no words, a null language is ``und``. Repeated rows count each time; ids and other columns are not
    looked at, but for the sample. A language without frequent phrases has no rows, so an empty table gives an empty result.
    """
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_pick")
    )
    found = frequent_phrases(texts, support, sample)
    known = found.filter("n > 0")
    words = F.split("phrase", " ")
    several = known.filter("n > 1")

    cuts = several.select("lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice(words, 1, F.col("k"))).alias("head"),
        F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.col("n") - F.col("k"))).alias("tail"),
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct(_score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    )

    # Every shorter phrase within a longer one, with the most occurrences of any longer one.
    longer = known.filter("n > 2").select("phrase", "lang", "n", "f", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    longer = longer.select("phrase", "lang", "f", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    held = longer.groupBy("lang", F.concat_ws(" ", F.slice(words, F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("f").alias("most"))
    # Products of counts with 100 may pass 64 bits as well.
    hundred = F.lit(100).cast("decimal(4,0)") * F.col("most").cast("decimal(20,0)")
    free = scored.join(held, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (hundred < F.lit(covered).cast("decimal(4,0)") * F.col("a").cast("decimal(20,0)"))
    )

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
    totals = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
