"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Training time runs from 0 to 1. A source's weight changes linearly over it, from ``start`` to
``end`` times its mean weight; integrating the schedule gives the share of its target that is due
by any time, and inverting that cumulative demand gives the time at which a token is due. The
documents of a source stand in a pseudo-random order; the running sum of sizes over up to
``max_epochs`` passes is their token demand, and positions are the inverted demand at the middle of
each copy. Documents are range-sorted by position.

Running sums never gather a source in one task: rows are dealt into about sqrt(rows) hash ranges
per source, summed within a range and shifted by the sums of earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

#: A word is a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: (start, end) of the weight over training time, as multiples of its mean; start + end = 2.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_EPOCHS = 3


def _cycle(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size).

    The sum of sizes is shared by weight; no target exceeds ``max_epochs`` times its source. The
    common price per weight is found exactly: sources are sorted by the price at which they are
    full, and with the first sources full, the rest shares what remains; the highest price that fills no further source is the one.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_price = Window.orderBy("full_at", "place")
    ranked = totals.withColumn("place", (F.row_number().over(by_name) - 1).cast("long")).withColumn(
        "weight", _cycle(weights, F.col("place"))
    ).withColumn("room", F.lit(float(max_epochs)) * F.col("source_size"))
    sums = ranked.withColumn("full_at", F.col("room") / F.col("weight")).select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.sum("weight").over(Window.partitionBy()).alias("all_weight"),
        F.coalesce(F.sum("room").over(by_price.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full_room"),
        F.coalesce(F.sum("weight").over(by_price.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full_weight"),
    )
    price = (F.col("total") - F.col("full_room")) / (F.col("all_weight") - F.col("full_weight"))
    settled = sums.withColumn("price", F.max(F.when(price <= F.col("full_at"), price)).over(Window.partitionBy()))
    return settled.select(
        "source", "source_size", "place",
        F.least(F.col("room"), F.coalesce(F.col("price"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _due(share: Column, start: Column, end: Column) -> Column:
    """Time at which a share of the target is due: the inverse of start*t + (end-start)*t*t/2."""
    slope = end - start
    root = F.sqrt(F.greatest(start * start + F.lit(2.0) * slope * share, F.lit(0.0)))
    return F.least(F.lit(1.0), F.lit(2.0) * share / (start + root))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    ramps: tuple[tuple[float, float], ...] = RAMPS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions), sorted by first position.

    ``taken`` counts the words the mix takes of a document over all passes; the last copy of a
    source's last document may be taken in part, so a source's words differ from its target by less
    than one. ``positions`` has the training time of each copy of which at least half is taken.
    Null and empty texts have size 0, take nothing and have no position; they come last. A null
    source is a source of its own, the last by name. Each repeated row counts as a document of its
    own. An empty table gives an empty result. Other columns are ignored.
    """
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("h", F.xxhash64("doc_id", F.lit(seed))),
        "sizes",
    )
    ranges = max(1, int(slim.count() ** 0.5))
    width = 2**64 // ranges + 1
    quotas = stage(
        targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets"
    )
    dealt = slim.join(quotas, slim["source"].eqNullSafe(quotas["source"])).select(
        slim["*"], "source_size", "target", "place",
        F.floor((F.col("h").cast("double") + 2.0**63) / F.lit(float(width))).cast("long").alias("part"),
    )
    earlier = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("place", "part").agg(F.sum("size").alias("part_size")).select(
        "place", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("place", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, ["place", "part"]).withColumn(
        "first", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    begin, end = _cycle(tuple(r[0] for r in ramps), F.col("place")), _cycle(tuple(r[1] for r in ramps), F.col("place"))
    goal = F.floor("target").cast("long")
    size = F.col("size")

    def offset(k: int) -> Column:
        return F.col("first") + F.lit(k) * F.col("source_size")

    taken = sum(
        (F.greatest(F.lit(0), F.least(size, goal - offset(k))) for k in range(max_epochs)), F.lit(0)
    )
    copies = F.array(*[
        F.when(
            (size > 0) & (F.lit(2) * offset(k) + size <= F.lit(2) * goal),
            _due((offset(k) + size / 2.0) / F.col("target"), begin, end),
        )
        for k in range(max_epochs)
    ])
    return (
        placed.select(
            "doc_id", "source", "size", "source_size", "target",
            taken.cast("long").alias("taken"), F.array_compact(copies).alias("positions"),
        )
        .orderBy(F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1).asc_nulls_last(), "doc_id")
    )
