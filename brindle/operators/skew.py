"""Per-key results where a few keys hold most rows.

Value-frequency compression: rows are folded to (key, value, count) before anything is done per key, so a key
costs as much as it has distinct values, and the fold itself is partial before the shuffle. Exact distinct
counts, means, modes and percentiles follow from the weighted values. Percentiles come from cumulated counts over
sampled ranges of the values, so that even a key of unboundedly many distinct values never comes together in one
task.

Defined cases: null and NaN values count as rows but take no part in mean, mode, distinct count and
percentile; -0.0 equals 0.0; of equally frequent values the smallest is the mode; keys without any value get
NULL there; the null key is a key of its own, but never a heavy one; empty input gives no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut


def compressed(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, n): distinct values of each key with their number of rows; NaN is read as null."""
    value = value.cast("double")
    clean = F.when(F.isnan(value), F.lit(None)).when(value == 0, F.lit(0.0)).otherwise(value)
    return rows.groupBy(key.alias("key"), clean.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def key_statistics(pairs: DataFrame) -> DataFrame:
    """key, n, n_value, mean_value, distinct_values, mode_value from compressed pairs."""
    known = F.col("value").isNotNull()
    n = F.when(known, F.col("n"))
    mode = F.max(F.when(known, F.struct(F.col("n").alias("n"), (-F.col("value")).alias("low"))))
    return (
        pairs.groupBy("key")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(n), F.lit(0)).alias("n_value"),
            F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(n)).alias("mean_value"),
            F.count("value").alias("distinct_values"),
            mode.alias("__mode"),
        )
        .withColumn("mode_value", F.lit(0.0) - F.col("__mode.low"))
        .drop("__mode")
    )


def cumulated(pairs: DataFrame) -> DataFrame:
    """pairs (key, value, n, ...) + run, total: the key's rows up to and including this value, and all of them.

    The pairs are cut into ranges of (key, value) by sampled quantiles, so that the ranges are even whatever the values
    are, and a key of unboundedly many values has many of them; counts are cumulated over the ranges of a key and within
    each range. The ranges are written once, as both must see the same ones.
    """
    ranged = cut(pairs.repartitionByRange("key", "value").withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("key", "__range").agg(F.sum("n").alias("__n"))
    along = Window.partitionBy("key")
    sums = sums.select(
        F.col("key").alias("__k"), F.col("__range").alias("__r"), (F.sum("__n").over(along.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(along).alias("total")
    )
    inside = F.sum("n").over(Window.partitionBy("__range", "key").orderBy("value"))
    joined = ranged.withColumn("__in", inside).join(sums, (F.col("__range") == F.col("__r")) & F.col("key").eqNullSafe(F.col("__k")))
    return joined.withColumn("run", F.col("__before") + F.col("__in")).drop("__k", "__r", "__before", "__in", "__range")


def weighted_percentile(pairs: DataFrame, p: float) -> DataFrame:
    """(key, percentile): the smallest value whose cumulated count reaches p of the key's valued rows."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    rows = cumulated(pairs.filter(F.col("value").isNotNull()).select("key", "value", "n"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))).cast("long")
    return rows.filter((F.col("run") >= rank) & (F.col("run") - F.col("n") < rank)).select("key", F.col("value").alias("percentile"))


def heavy_keys(pairs: DataFrame, share_inverse: int = 50, rows: DataFrame | None = None) -> DataFrame:
    """(key, n) of the keys that hold at least 1/share_inverse of all rows, from compressed pairs.

    rows: the rows the pairs were made from; counting them spares making the pairs a second time for their sum.
    """
    counts = pairs.groupBy("key").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total")) if rows is None else rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.filter(F.col("key").isNotNull() & (F.col("n") * F.lit(share_inverse) >= total.scalar()))


def heavy_log_keys(reactions: DataFrame, posts: DataFrame, share_inverse: int = 50) -> DataFrame:
    """(field, key) of the heavy posts of the reactions and the heavy authors of the posts."""
    by_post = heavy_keys(compressed(reactions, F.col("post_id"), F.col("value")), share_inverse, reactions)
    by_author = heavy_keys(compressed(posts, F.col("author_id"), F.col("features")["chars"]), share_inverse, posts)
    return by_post.select(F.lit("post_id").alias("field"), "key").unionByName(
        by_author.select(F.lit("author_id").alias("field"), "key")
    )
