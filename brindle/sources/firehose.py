"""Firehose messages to posts and reactions.

Works alike on batch and streaming DataFrames whose rows have did, time_us, kind and commit (`read_json` gives them from
lines of JSON). Defined cases: only creates (for posts also updates) of the known collections count; malformed subject
uris give nothing; createdAt without offset is UTC, an unreadable one falls back to time_us, then to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POST, LIKE, REPOST = "app.bsky.feed.post", "app.bsky.feed.like", "app.bsky.feed.repost"
URI = r"^at://([^/]+)/app\.bsky\.feed\.post/([^/]+)$"
SCHEMA = (
    "did string, time_us long, kind string, commit struct<operation: string, collection: string, rkey: string, rev: string, "
    "record: struct<createdAt: string, text: string, reply: struct<parent: struct<uri: string>>, subject: struct<uri: string>, via: string>>"
)


def parse_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Messages from a column of JSON text (e.g. of a text or Kafka source); unreadable lines are left out."""
    return lines.select(F.from_json(F.col(column).cast("string"), SCHEMA).alias("m")).filter("m is not null and m.did is not null").select("m.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_json(spark.read.text(path))


def sampled(messages: DataFrame, rate: float) -> DataFrame:
    """Messages of a fixed share of actors: an actor's messages are kept all or none."""
    if rate >= 1:
        return messages
    if rate <= 0:
        return messages.filter(F.lit(False))
    return messages.filter(F.pmod(F.xxhash64("did"), F.lit(1_000_000)) < int(rate * 1_000_000))


def _operation(*names: str) -> Column:
    return (F.col("kind") == "commit") & F.lower(F.trim(F.col("commit.operation"))).isin(*names)


def created_seconds(text: Column, time_us: Column) -> Column:
    """Epoch seconds of an ISO text, else of the stamp, else 0."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.trim(text))) / 1e6, time_us / 1e6, F.lit(0.0))


def post_uri(did: Column, rkey: Column) -> Column:
    return F.concat(F.lit("at://"), did, F.lit(f"/{POST}/"), rkey)


def posts(messages: DataFrame) -> DataFrame:
    """(post_id, author_id, created_at, features) of created and updated posts."""
    rows = messages.filter(_operation("create", "update") & (F.col("commit.collection") == POST) & F.col("did").isNotNull() & F.col("commit.rkey").isNotNull())
    r = "commit.record"
    reply = F.when(F.col(f"{r}.reply.parent.uri").isNotNull(), 1.0).otherwise(0.0)
    return rows.select(
        post_uri(F.col("did"), F.col("commit.rkey")).alias("post_id"),
        F.col("did").alias("author_id"),
        created_seconds(F.col(f"{r}.createdAt"), F.col("time_us")).alias("created_at"),
        F.create_map(F.lit("chars"), F.length(F.coalesce(F.col(f"{r}.text"), F.lit(""))).cast("double"), F.lit("is_reply"), reply).alias("features"),
    )


def reactions(messages: DataFrame) -> DataFrame:
    """(user_id, post_id, value, kind, timestamp) of likes (+0.5) and reposts (+1) of posts."""
    c = F.col("commit.collection")
    rows = messages.filter(_operation("create") & c.isin(LIKE, REPOST)).withColumn("post_id", F.col("commit.record.subject.uri"))
    return rows.filter(F.col("post_id").rlike(URI) & F.col("did").isNotNull()).select(
        F.col("did").alias("user_id"),
        "post_id",
        F.when(c == LIKE, 0.5).otherwise(1.0).alias("value"),
        F.when(c == LIKE, "favorite").otherwise("boost").alias("kind"),
        created_seconds(F.col("commit.record.createdAt"), F.col("time_us")).alias("timestamp"),
    )


def post_from_uri(rows: DataFrame, created_at: Column) -> DataFrame:
    """Posts known only as targets of reactions: (post_id, author_id, created_at, features empty)."""
    author = F.regexp_extract("post_id", URI, 1)
    return rows.filter(author != "").select("post_id", author.alias("author_id"), created_at.alias("created_at"), F.create_map().cast("map<string,double>").alias("features"))


def liked_posts(reactions: DataFrame, now: Column) -> DataFrame:
    """Targets of positive reactions as posts, of the time of their earliest reaction (now where it has none)."""
    at = F.when(F.col("timestamp") > 0, F.col("timestamp")).otherwise(now)
    return post_from_uri(reactions.filter("value > 0").groupBy("post_id").agg(F.min(at).alias("__at")), F.col("__at"))


def latest_posts(rows: DataFrame, most: int | None = None) -> DataFrame:
    """One row per post, the newest wins; with `most`, only the newest posts.

    Where rows have liked and batch, a post known only from likes (liked) keeps the row of its first batch, and gives way
    to any row of the post itself; liked is kept.
    """
    if "liked" in rows.columns:
        order, kept = [~F.col("liked"), F.when(F.col("liked"), -F.col("batch")), "created_at", "author_id", "liked"], ["p.liked"]
    else:
        order, kept = ["created_at", "author_id"], []
    one = rows.groupBy("post_id").agg(F.max(F.struct(*order)).alias("p")).select("post_id", "p.author_id", "p.created_at", *kept)
    return one if most is None else one.orderBy(F.desc("created_at"), "post_id").limit(most)
