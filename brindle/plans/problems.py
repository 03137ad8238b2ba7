"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import changefeed, dedup, lateness, skew, timestamps
from brindle.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.repo_records(table(spark, d, "firehose")).select("did", "collection", "rkey", "rev")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt table with the content of every record."""
    live = changefeed.repo_records(table(spark, d, "firehose"))
    return live.select(
        "did",
        "collection",
        "rkey",
        "rev",
        F.col("record.createdAt").alias("created_at"),
        F.col("record.text").alias("text"),
        F.col("record.subject.uri").alias("subject_uri"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    created = lateness.created_events(table(spark, d, "firehose"), table(spark, d, "clients"))
    reacted = lateness.reaction_events(table(spark, d, "reactions"))
    return lateness.late_rows(created.unionByName(reacted))


def p2_hours(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour of happening for both logs: as published when the grace ends, and as corrected."""
    created = lateness.created_events(table(spark, d, "firehose"), table(spark, d, "clients"))
    reacted = lateness.reaction_events(table(spark, d, "reactions"))
    return lateness.period_aggregates(lateness.kslack(created.unionByName(reacted), publish=["src"]), ["src"], "row_id")


def p2_reaction_hours(spark: SparkSession, d: str) -> DataFrame:
    events = lateness.kslack(lateness.reaction_events(table(spark, d, "reactions")), publish=["src"])
    return lateness.period_aggregates(events, ["src"], "row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised_stamps(table(spark, d, "firehose"), table(spark, d, "posts"), table(spark, d, "clients"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_log_keys(table(spark, d, "reactions"), table(spark, d, "posts"))


def _statistics(pairs: DataFrame, key: str) -> DataFrame:
    median = skew.weighted_percentile(pairs, 0.5)
    out = skew.key_statistics(pairs).join(median.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")), "left")
    return out.select(
        F.col("key").alias(key),
        "n",
        "n_value",
        (F.round("mean_value", 6) + F.lit(0.0)).alias("mean_value"),
        "distinct_values",
        "mode_value",
        F.col("percentile").alias("median_value"),
    )


def p4_post_values(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(skew.compressed(table(spark, d, "reactions"), F.col("post_id"), F.col("value")), "post_id")


def p4_author_posts(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(skew.compressed(table(spark, d, "posts"), F.col("author_id"), F.col("features")["chars"]), "author_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.redundant_messages(table(spark, d, "firehose"), table(spark, d, "reactions"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_hours": p2_hours,
    "p2_reaction_hours": p2_reaction_hours,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_post_values": p4_post_values,
    "p4_author_posts": p4_author_posts,
    "p6_found": p6_found,
}

_LATEST = """
WITH c AS (SELECT did, commit.collection AS collection, commit.rkey AS rkey, commit.rev AS rev,
                  lower(trim(commit.operation)) AS op, commit.record AS record
           FROM firehose WHERE kind = 'commit'),
     k AS (SELECT DISTINCT ON (did, collection, rkey) * FROM c WHERE op IN ('create', 'update', 'delete') AND rev IS NOT NULL
           ORDER BY did, collection, rkey, rev DESC, op DESC)
"""

_EVENTS = """
WITH r AS (SELECT *, CASE WHEN msg_id IS NULL THEN NULL ELSE shard END AS s,
                  CASE WHEN msg_id IS NULL THEN user_id END AS u, CASE WHEN msg_id IS NULL THEN post_id END AS p,
                  CASE WHEN msg_id IS NULL THEN kind END AS k, CASE WHEN msg_id IS NULL THEN "timestamp" END AS t
           FROM reactions WHERE "timestamp" > 0),
     f AS (SELECT ordinal AS row_id, CAST(floor("timestamp") AS BIGINT) * 1000000
                  + CAST(floor(("timestamp" - floor("timestamp")) * 1000000 + 0.5) AS BIGINT) AS happened_us, arrived_us
           FROM r QUALIFY row_number() OVER (PARTITION BY s, msg_id, u, p, k, t ORDER BY ordinal) = 1),
     e AS (SELECT *, happened_us - happened_us % 3600000000 AS period_us FROM f),
     v AS (SELECT *, CASE WHEN arrived_us - period_us - 3600000000 <= 600000000 THEN 'in_time'
                          WHEN arrived_us - period_us - 3600000000 <= 86400000000 THEN 'correction' ELSE 'too_late' END AS verdict
           FROM e),
     g AS (SELECT *, happened_us - lag(happened_us) OVER (PARTITION BY period_us ORDER BY happened_us, row_id) AS gap
           FROM v WHERE verdict <> 'too_late')
"""


def _stats_sql(rows: str, key: str, value: str) -> str:
    return f"""
WITH r AS (SELECT {key} AS k, CASE WHEN isnan({value}) THEN NULL ELSE {value} END AS v FROM {rows}),
     w AS (SELECT k, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY k, v),
     m AS (SELECT DISTINCT ON (k) k, v FROM w ORDER BY k, n DESC, v)
SELECT r.k AS {key}, count(*) AS n, count(r.v) AS n_value, round(avg(r.v), 6) + 0.0 AS mean_value,
       count(DISTINCT r.v) AS distinct_values, any_value(m.v) AS mode_value, quantile_disc(r.v, 0.5) AS median_value
FROM r LEFT JOIN m ON r.k IS NOT DISTINCT FROM m.k GROUP BY r.k
"""


SQL = {
    "p1_found": _LATEST + "SELECT did, collection, rkey, rev FROM k WHERE op <> 'delete'",
    "p1_records": _LATEST
    + """SELECT did, collection, rkey, rev, record.createdAt AS created_at, record."text" AS "text", record.subject.uri AS subject_uri
         FROM k WHERE op <> 'delete'""",
    "p2_reaction_hours": _EVENTS
    + """SELECT 'reactions' AS src, v.period_us, count(*) FILTER (verdict = 'in_time') AS provisional_n,
                count(*) FILTER (verdict <> 'too_late') AS n, count(*) FILTER (verdict = 'correction') AS corrections,
                count(*) FILTER (verdict = 'too_late') AS too_late, any_value(x.gap) AS longest_gap_us,
                any_value(x.first_row) AS first_row, any_value(x.last_row) AS last_row
         FROM v LEFT JOIN (SELECT period_us, max(gap) AS gap, arg_min(row_id, (happened_us, row_id)) AS first_row,
                                  arg_max(row_id, (happened_us, row_id)) AS last_row FROM g GROUP BY 1) x USING (period_us)
         GROUP BY v.period_us""",
    "p4_found": """
SELECT 'post_id' AS field, post_id AS key FROM reactions WHERE post_id IS NOT NULL GROUP BY post_id
HAVING count(*) * 50 >= (SELECT count(*) FROM reactions)
UNION ALL
SELECT 'author_id', author_id FROM posts WHERE author_id IS NOT NULL GROUP BY author_id
HAVING count(*) * 50 >= (SELECT count(*) FROM posts)""",
    "p4_post_values": _stats_sql("reactions", "post_id", '"value"'),
    "p4_author_posts": _stats_sql("(SELECT author_id, features['chars'] AS chars FROM posts)", "author_id", "chars"),
    "p6_found": """
SELECT 'firehose' AS src, row_id FROM firehose WHERE kind = 'commit'
QUALIFY row_number() OVER (PARTITION BY did, commit.rev, commit.collection, commit.rkey ORDER BY row_id) > 1
UNION ALL
SELECT 'reactions', ordinal FROM reactions WHERE msg_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY shard, msg_id ORDER BY ordinal) > 1
UNION ALL
SELECT 'reactions', ordinal FROM reactions WHERE msg_id IS NULL
QUALIFY row_number() OVER (PARTITION BY user_id, post_id, kind, "timestamp" ORDER BY ordinal) > 1""",
}
