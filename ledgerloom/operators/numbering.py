"""Dense positions within a key, without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_position(
    rows: DataFrame, key: str, bucket: Column, order: list[str], out: str = "position"
) -> DataFrame:
    """Number the rows of each key from 0 in the order (bucket, *order).

    Rows without a key have no position. ``order`` must name every other column that is kept. Equal rows are counted
    before the shuffle, each (key, bucket) is numbered apart, and the buckets
    are shifted by the sizes of those before them, so a key with a third of all
    rows is spread over as many tasks as it has buckets.
    """
    # Without NULLs in the bucket both uses below share one exchange.
    counted = (
        rows.filter(F.col(key).isNotNull())
        .withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
        .groupBy(key, "_bucket", *order)
        .agg(F.count("*").alias("_copies"))
    )
    before = (Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(*before)
    in_key = Window.partitionBy(key).orderBy("_bucket").rowsBetween(*before)
    numbered = counted.withColumn("_start", F.coalesce(F.sum("_copies").over(in_bucket), F.lit(0)))
    shifts = (
        counted.groupBy(key, "_bucket").agg(F.sum("_copies").alias("_size"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(in_key), F.lit(0)))
        .select(key, "_bucket", "_shift")
    )
    first = F.col("_shift") + F.col("_start")
    # Merge, never broadcast: file sizes make the numbered side look small.
    return numbered.join(shifts.hint("merge"), [key, "_bucket"]).select(
        key, *order, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias(out)
    )
