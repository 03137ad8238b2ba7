"""Readers of rating datasets in their published layouts, to signed reactions and posts.

Every reader takes a path to files already present; none fetches anything.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.metrics import kcore


def is_present(path: str) -> bool:
    """Whether a data file is there and not a pointer left by a large-file store."""
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return not f.read(40).startswith(b"version https://git-lfs")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, rating) of the non-zero cells of a text matrix separated by blanks; rows are numbered by position.

    The file is read whole by line number through its one partition: such matrices are a few hundred lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("row", "line"))
    cells = lines.select("row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "cell"))
    return cells.select("row", "col", F.expr("try_cast(cell AS double)").alias("rating")).filter("rating <> 0")


def coat_reactions(cells: DataFrame, propensities: DataFrame | None = None) -> DataFrame:
    """(user_id, post_id, value[, propensity]): ratings 1 to 5 as (r - 3) / 2."""
    rows = cells if propensities is None else cells.join(propensities.select("row", "col", F.col("rating").alias("propensity")), ["row", "col"], "left")
    keep = [F.col("propensity")] if propensities is not None else []
    return rows.select(F.concat(F.lit("u"), "row").alias("user_id"), F.concat(F.lit("i"), "col").alias("post_id"), ((F.col("rating") - 3.0) / 2.0).alias("value"), *keep)


def movielens(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, post_id, value, ts) of tab-separated user, item, rating, time."""
    rows = spark.read.csv(path, sep="\t", schema="user_id string, post_id string, rating double, ts double")
    return rows.select("user_id", "post_id", ((F.col("rating") - 3.0) / 2.0).alias("value"), "ts")


_NAMES = {"comment": ("comment-id", "comment_id", "tid"), "voter": ("voter-id", "voter_id", "pid", "participant"), "author": ("author-id", "author_id"), "group": ("group-id", "group_id")}


def _named(df: DataFrame, what: str) -> str:
    found = next((c for c in _NAMES[what] if c in df.columns), None)
    if found is None:
        raise ValueError(f"no column for {what} among {df.columns}")
    return found


def conversation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(votes, comments, groups) of an opinion conversation; participants without a group are left out."""
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True)
    v, c, p = read("votes"), read("comments"), read("participants-votes")
    votes = v.select(F.col(_named(v, "comment")).alias("comment"), F.col(_named(v, "voter")).alias("voter"), F.expr("try_cast(vote AS double)").alias("vote"))
    comments = c.select(F.col(_named(c, "comment")).alias("comment"), F.col(_named(c, "author")).alias("author"))
    group = F.expr(f"try_cast(`{_named(p, 'group')}` AS double)")
    return votes, comments, p.select(F.col(_named(p, "voter")).alias("voter"), group.cast("int").alias("group")).filter("group is not null")


def conversations(root: str) -> list[str]:
    return sorted(n for n in os.listdir(root) if os.path.isfile(os.path.join(root, n, "votes.csv"))) if os.path.isdir(root) else []


def conversation_reactions(votes: DataFrame, comments: DataFrame, include_pass: bool = False) -> DataFrame:
    """(user_id, post_id, author_id, value); authors of unknown comments are `auth?`; passes count 0 only on demand."""
    rows = votes.filter("vote is not null" if include_pass else "vote is not null and vote <> 0").join(comments, "comment", "left")
    return rows.select(
        F.concat(F.lit("v"), "voter").alias("user_id"), F.concat(F.lit("c"), "comment").alias("post_id"),
        F.concat(F.lit("auth"), F.coalesce("author", F.lit("?"))).alias("author_id"), F.col("vote").alias("value"),
    )


def group_split(votes: DataFrame, groups: DataFrame) -> DataFrame:
    """(comment, group, mean) of all votes of grouped participants, passes included."""
    return votes.filter("vote is not null").join(groups, "voter").groupBy("comment", "group").agg(F.avg("vote").alias("mean"))


def adminship_votes(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt, vote, year) of blank-line separated KEY:VALUE records; empty names, self votes and bad numbers go.

    A gzip file is read by one task, as it cannot be split.
    """
    text = spark.read.text(path, lineSep="\n\n").select(F.concat(F.lit("\n"), "value").alias("t"))
    field = lambda k: F.trim(F.regexp_extract("t", rf"\n{k}:([^\n]*)", 1))
    rows = text.select(field("SRC").alias("src"), field("TGT").alias("tgt"), field("VOT").alias("v"), field("YEA").alias("y"))
    rows = rows.select("src", "tgt", F.expr("try_cast(v AS int)").alias("vote"), F.expr("try_cast(y AS int)").alias("year"))
    return rows.filter("src <> '' and tgt <> '' and src <> tgt and vote is not null and year is not null")


def adminship_reactions(votes: DataFrame, least_src: int = 5, least_tgt: int = 15, include_neutral: bool = False) -> DataFrame:
    """(user_id, post_id, author_id, value): votes of active sources on well-voted targets; activity counts all votes."""
    src = votes.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_src).select("src")
    tgt = votes.groupBy("tgt").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_tgt).select("tgt")
    rows = votes.join(src, "src", "left_semi").join(tgt, "tgt", "left_semi")
    rows = rows if include_neutral else rows.filter("vote <> 0")
    return rows.select(F.col("src").alias("user_id"), F.concat_ws("@", "tgt", F.col("year").cast("string")).alias("post_id"), F.col("tgt").alias("author_id"), F.col("vote").cast("double").alias("value"))


#: Published labels of helpfulness and their values (fixed values).
HELPFULNESS = {"HELPFUL": 1.0, "SOMEWHAT_HELPFUL": 0.0, "NOT_HELPFUL": -1.0}


def notes_slice(ratings: DataFrame, status: DataFrame, notes: DataFrame, least_note: int = 30, least_rater: int = 30, most_notes: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(ratings, notes) of decided notes in the core where all have enough ratings, of the `most_notes` most rated.

    ratings (noteId, raterId, helpfulnessLevel) may come from several shards; status (noteId, currentStatus).
    """
    value = F.lit(None).cast("double")
    for name, v in HELPFULNESS.items():
        value = F.when(F.col("helpfulnessLevel") == name, F.lit(v)).otherwise(value)
    decided = status.filter(F.col("currentStatus").isin("CURRENTLY_RATED_HELPFUL", "CURRENTLY_RATED_NOT_HELPFUL"))
    rows = ratings.select("noteId", "raterId", value.alias("value")).filter("value is not null").join(decided.select("noteId"), "noteId", "left_semi")
    core = kcore(rows, "noteId", "raterId", least_note, least_rater)
    top = core.groupBy("noteId").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "noteId").limit(most_notes)
    core = kcore(core.join(top.select("noteId"), "noteId", "left_semi"), "noteId", "raterId", least_note, least_rater)
    kept = core.select("noteId").distinct().join(decided, "noteId").join(notes, "noteId", "left")
    binary = F.when(F.col("currentStatus") == "CURRENTLY_RATED_HELPFUL", 1).otherwise(0)
    return core, kept.select("noteId", F.col("noteAuthorParticipantId").alias("author"), F.col("currentStatus").alias("status"), binary.alias("statusBinary"))


def note_reactions(ratings: DataFrame, notes: DataFrame) -> DataFrame:
    """(user_id, post_id, author_id, value) of ratings of known notes; a missing author is `anon:` and the note."""
    author = F.coalesce("author", F.concat(F.lit("anon:"), F.col("noteId").cast("string")))
    rows = ratings.join(notes.select("noteId", author.alias("author_id")), "noteId")
    return rows.select(F.col("raterId").alias("user_id"), F.col("noteId").cast("string").alias("post_id"), "author_id", "value")
