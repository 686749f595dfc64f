"""Ranked lexical search over a length-stratified index.

Documents with an equal length normaliser m form a stratum; within it the postings of a term are grouped by
tf, so an impact is computed once per tf and stratum. Strata are cut into blocks of bounded size. From the
highest tf of each term a block has a bound on any score in it. A query first visits its blocks of the
highest bounds; the k-th score found there is its floor, and of all other blocks only those whose bound
reaches the floor are visited. So every document that could rank is scored, exactly, and no other block is.

Queries are taken in sets of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean, stage
from ledgerloom.llm.wordscan import GAP, WORD, scan, slices

#: (item, term) pairs of one set of queries, about; what is sent to tasks is a few times that.
PAIRS = 200_000
#: Documents of a block of a stratum, about.
BLOCK = 4096
#: Blocks that a query visits for its floor: at least so many, more while they hold few documents, up to a limit.
FIRST, FIRST_LIMIT = 4, 512

_KIND = np.full(256, GAP, dtype=np.uint8)
_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = WORD
_INDEX = "m long, block long, ids array<long>, places binary, terms binary, tfs binary, bounds array<long>"
_HITS = "item int, doc_id long, score long"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, row, _ = scan(batch.column("text"), _KIND)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), words.cast(pa.string())], ["item_id", "term"])


def _doc_terms(vocabulary):
    """Of each document its number of terms and, for the terms asked for, their numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value
        for batch in batches:
            for part in slices(batch):
                words, row, _ = scan(part.column("text"), _KIND)
                size = np.bincount(row, minlength=part.num_rows)
                found = pc.index_in(words, asked)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                term = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)[hit]
                pairs, tf = np.unique(row[hit] * np.int64(len(asked)) + term, return_counts=True)
                own = pairs // len(asked)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=part.num_rows))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(size.astype(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array((pairs % len(asked)).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return lean(run)


@dataclass
class Asked:
    """A set of queries: their pairs of item and term, ordered by item, and the weight of each term."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    best: int

    def of(self, item: int) -> np.ndarray:
        return self.terms[self.starts[item]:self.starts[item + 1]]


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (np.int64(1_000_000_000) * tf) // (1000 * tf + 20 * m)


def _build(shared):
    """A block: postings by term, then tf, then document, and the bound of each query."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked: Asked = shared.value
        m = key[0].as_py()
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end"))
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        place = np.repeat(np.arange(table.num_rows), terms.value_lengths().to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order].astype(np.int64), place[order]
        most = np.zeros(len(asked.weights), dtype=np.int64)
        last = np.flatnonzero(np.append(term[1:] != term[:-1], True)) if len(term) else np.empty(0, np.int64)
        most[term[last]] = asked.weights[term[last]] * impacts(tf[last], m)
        bounds = np.add.reduceat(np.append(most[asked.terms], 0), asked.starts[:-1])
        return pa.table({
            "m": [m], "block": [key[1].as_py()], "ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "places": pa.array([place.astype("<i4").tobytes()], pa.binary()), "terms": pa.array([term.astype("<i4").tobytes()], pa.binary()),
            "tfs": pa.array([tf.astype("<i8").tobytes()], pa.binary()), "bounds": pa.array([bounds.tolist()], pa.list_(pa.int64())),
        })

    return run


def _search(shared, floors: np.ndarray | None):
    """Scores of documents, of each block and query the best that reach the floor.

    Without floors the block names the queries that visit it; else those whose bound reaches their floor do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                m, ids = batch.column("m")[i].as_py(), batch.column("ids")[i].values
                place, term = (np.frombuffer(batch.column(c)[i].as_py(), dtype="<i4") for c in ("places", "terms"))
                tf = np.frombuffer(batch.column("tfs")[i].as_py(), dtype="<i8")
                # One impact for each run of a term and a tf.
                runs = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
                worth = np.repeat(asked.weights[term[runs]] * impacts(tf[runs], m), np.diff(np.append(runs, len(term))))
                begin = np.searchsorted(term, np.arange(len(asked.weights) + 1))
                bounds = batch.column("bounds")[i].values.to_numpy()
                visits = batch.column("items")[i].as_py() if floors is None else np.flatnonzero((bounds > 0) & (bounds >= floors))
                out = []
                for item in visits:
                    terms = asked.of(item)
                    size = begin[terms + 1] - begin[terms]
                    at = np.repeat(begin[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    if bounds[item] < 1 << 53:  # sums of integers below that are exact in doubles
                        score = np.bincount(place[at], worth[at], minlength=len(ids)).astype(np.int64)
                    else:
                        score = np.zeros(len(ids), dtype=np.int64)
                        np.add.at(score, place[at], worth[at])
                    near = np.flatnonzero(score >= (1 if floors is None else max(1, floors[item])))
                    near = near[np.argsort(-score[near], kind="stable")][:asked.best]
                    out.append((np.full(len(near), item), near, score[near]))
                if out:
                    item, near, score = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item.astype(np.int32)), ids.take(pa.array(near)), pa.array(score.astype(np.int64))], ["item", "doc_id", "score"]
                    )

    return lean(run)


def _ranked(hits: DataFrame, best: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _search_set(docs: DataFrame, pairs: list, best: int) -> DataFrame | None:
    """(item_id, doc_id, score): what any of one set of queries may rank."""
    spark = docs.sparkSession
    vocabulary = pa.array(sorted({p["term"] for p in pairs}), pa.large_string())
    number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    items = sorted({p["item_id"] for p in pairs})
    own: dict = {i: set() for i in items}
    for p in pairs:
        own[p["item_id"]].add(number[p["term"]])
    terms = spark.sparkContext.broadcast(vocabulary)
    counted = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _doc_terms(terms), "doc_id long, n long, terms array<int>, tfs array<int>"
        ).filter("n > 0"),
        "doc-terms",
    )
    whole = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    if not whole["docs"]:
        return None
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the set at most
        weights[term] = int(np.floor(1000 * np.log((2 * whole["docs"] + 2) / (2 * df + 1))))
    sizes = [len(own[i]) for i in items]
    shared = spark.sparkContext.broadcast(Asked(
        np.append(0, np.cumsum(sizes)), np.concatenate([np.sort(np.array(list(own[i]), dtype=np.int64)) for i in items]), weights, best,
    ))
    m = F.expr(f"100 - 50 + ((50L * n * {whole['docs']}L) div {whole['words']}L)")
    holding = counted.filter("size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs")
    strata = holding.groupBy("m").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # Copies of a row would share a hash of theirs; a number of the row does not.
    dealt = holding.withColumn("_row", F.monotonically_increasing_id()).join(strata, "m").withColumn(
        "block", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("long")
    )
    # Dealt by block: else a crowded stratum would stay in the task that the join put it in.
    spread = dealt.select("m", "block", "doc_id", "terms", "tfs").repartition("m", "block")
    index = stage(spread.groupBy("m", "block").applyInArrow(_build(shared), _INDEX), "strata")

    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "block")
    first = (
        index.select("m", "block", F.size("ids").alias("held"), F.posexplode("bounds").alias("item", "bound")).filter("bound > 0")
        .withColumn("turn", F.row_number().over(by_bound)).filter(F.col("turn") <= FIRST_LIMIT)
        .withColumn("held", F.sum("held").over(by_bound.rowsBetween(Window.unboundedPreceding, 0)) - F.col("held"))
        .filter((F.col("turn") <= FIRST) | (F.col("held") < 4 * best))
        .groupBy("m", "block").agg(F.collect_list("item").alias("items"))
    )
    seen = index.join(first, ["m", "block"]).mapInArrow(_search(shared, None), _HITS)
    floors = np.zeros(len(items), dtype=np.int64)
    for r in _ranked(seen, best, "item").filter(F.col("rank") == best).collect():  # a row for each query of the set at most
        floors[r["item"]] = r["score"]
    names = spark.createDataFrame([(k, i) for k, i in enumerate(items)], "item int, item_id long")
    return index.mapInArrow(_search(shared, floors), _HITS).join(names, "item").select("item_id", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, best: int = 50, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0.

    Terms are runs of 0-9, A-Z, a-z and all characters beyond ASCII, with only A-Z lower-cased. N documents have a term,
    L is the number of their terms, n that of one document, df the number of documents with a term, tf its count in one.
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and a score is the sum of
    w * ((10^9 tf) div (1000 tf + 20 m)) over the different terms of the item.

    A null or empty text has no terms: such a document is not counted, such an item has no rows, nor has an item without
    an id. Rows that repeat an item's id are one item with the terms of all of them. Every row of documents ranks on its
    own, also where it repeats an id; ties go to the smaller doc_id, null last. Without documents the result is empty.
    """
    spark = docs.sparkSession
    asked = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    terms = stage(asked.mapInArrow(_item_terms, "item_id long, term string").distinct(), "item-terms")
    sets = -(-terms.count() // pairs)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(sets):
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k).collect()  # about ``pairs`` rows
        found = _search_set(docs, own, best) if own else None
        if found is not None:
            out = out.unionByName(found)
    return _ranked(out, best, "item_id").select("item_id", "rank", "doc_id", "score")
