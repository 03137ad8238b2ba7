"""Mixed timestamp formats and zones to one unambiguous form: microseconds since 1970 UTC.

Shape masks pick a parser once per distinct shape, wall clocks go through versioned zone transition
tables (see `brindle.functions.instants`). Defined cases: null, empty, blank or impossible texts name no instant and
give NULL, as do digits and letters beyond ASCII; a zone's name in brackets behind an offset is skipped, whatever it
holds; years 1 to 9999 are read, in the zone rules of their time; numbers that are null, NaN, infinite, zero or
negative give NULL; extra columns of any name pass through; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.instants import double_us, integer_is_us, integer_us, text_us


def with_client(rows: DataFrame, via: Column, clients: DataFrame) -> DataFrame:
    """`rows` with columns __zone and __day_first of the client named by `via`.

    A client given twice counts once. No broadcast is forced: Spark compares the size of `clients` with
    spark.sql.autoBroadcastJoinThreshold.
    """
    one = clients.groupBy(F.col("client").alias("__client")).agg(
        F.max("zone").alias("__zone"), F.max("day_first").alias("__day_first")
    )
    return rows.withColumn("__via", via).join(one, F.col("__via") == F.col("__client"), "left").drop("__via", "__client")


def firehose_instants(firehose: DataFrame, clients: DataFrame) -> DataFrame:
    """firehose + created_us (of createdAt) and arrived_us (of time_us), NULL where no instant is named."""
    rows = firehose.withColumn("arrived_us", integer_us(F.col("time_us")))
    rows = with_client(rows, F.col("commit.record.via"), clients)
    made = text_us(F.col("commit.record.createdAt"), F.col("__zone"), F.col("__day_first"), F.col("arrived_us"))
    return rows.withColumn("created_us", made).drop("__zone", "__day_first")


def normalised_stamps(firehose: DataFrame, posts: DataFrame, clients: DataFrame) -> DataFrame:
    """(field, key, utc_us) of every createdAt naming an instant, every time_us in another unit, every known created_at."""
    slim = firehose.select(
        "row_id",
        "time_us",
        F.struct(
            F.struct(F.col("commit.record.createdAt").alias("createdAt"), F.col("commit.record.via").alias("via")).alias("record")
        ).alias("commit"),
    )
    seen = firehose_instants(slim, clients)
    key = F.col("row_id").cast("string")
    stacked = seen.select(
        F.explode(
            F.array(
                F.struct(F.lit("createdAt").alias("field"), key.alias("key"), F.col("created_us").alias("utc_us")),
                F.struct(
                    F.lit("time_us").alias("field"),
                    key.alias("key"),
                    F.when(~integer_is_us(F.col("time_us")), F.col("arrived_us")).alias("utc_us"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    of_posts = posts.select(
        F.lit("created_at").alias("field"), F.col("post_id").alias("key"), double_us(F.col("created_at")).alias("utc_us")
    )
    return stacked.unionByName(of_posts).filter(F.col("utc_us").isNotNull())
