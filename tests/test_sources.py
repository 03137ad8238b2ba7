"""Readers on small files in their published layouts, and the streams of the service."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.plans.window import Engine
from brindle.sources import firehose, ratings
from brindle.streaming import service


def test_matrix_and_coat(spark, tmp_path):
    (tmp_path / "m.ascii").write_text("0 5 3\n1 0 0\n")
    rows = ratings.coat_reactions(ratings.matrix(spark, str(tmp_path / "m.ascii")))
    assert sorted(map(tuple, rows.collect())) == [("u0", "i1", 1.0), ("u0", "i2", 0.0), ("u1", "i0", -1.0)]


def test_movielens(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t7\t5\t100\n2\t7\t1\t101\n")
    assert sorted(map(tuple, ratings.movielens(spark, str(tmp_path / "u.data")).collect())) == [("1", "7", 1.0, 100.0), ("2", "7", -1.0, 101.0)]


def test_conversation(spark, tmp_path):
    d = tmp_path / "talk"
    d.mkdir()
    (d / "votes.csv").write_text("timestamp,comment-id,voter-id,vote\n1,0,9,1\n2,0,8,0\n3,5,9,-1\n4,0,7,\n")
    (d / "comments.csv").write_text("comment-id,author-id,comment-body\n0,3,hello\n")
    (d / "participants-votes.csv").write_text("participant,group-id\n9,0\n8,1\n7,\n")
    votes, comments, groups = ratings.conversation(spark, str(d))
    assert sorted(map(tuple, ratings.conversation_reactions(votes, comments).collect())) == [("v9", "c0", "auth3", 1.0), ("v9", "c5", "auth?", -1.0)]
    assert sorted(map(tuple, groups.collect())) == [("8", 1), ("9", 0)] and ratings.conversations(str(tmp_path)) == ["talk"]
    assert {(r["comment"], r["group"]): r["mean"] for r in ratings.group_split(votes, groups).collect()}[("0", 1)] == 0.0


def test_adminship(spark, tmp_path):
    text = "SRC:a\nTGT:b\nVOT:1\nRES:1\nYEA:2013\nDAT:x\nTXT:so: good\n\nSRC:a\nTGT:a\nVOT:1\nYEA:2013\n\nSRC:c\nTGT:b\nVOT:zero\nYEA:2013\n\nSRC:c\nTGT:b\nVOT:-1\nYEA:2012\n"
    with gzip.open(tmp_path / "votes.txt.gz", "wt") as f:
        f.write(text)
    votes = ratings.adminship_votes(spark, str(tmp_path / "votes.txt.gz"))
    assert sorted(map(tuple, votes.collect())) == [("a", "b", 1, 2013), ("c", "b", -1, 2012)]
    assert sorted(r["post_id"] for r in ratings.adminship_reactions(votes, 1, 2).collect()) == ["b@2012", "b@2013"]


def test_notes(spark):
    r = spark.createDataFrame([(n, f"r{k}", "HELPFUL" if k else "NOT_HELPFUL") for n in (1, 2) for k in range(3)] + [(3, "r0", "HELPFUL"), (1, "r9", None)], "noteId long, raterId string, helpfulnessLevel string")
    s = spark.createDataFrame([(1, "CURRENTLY_RATED_HELPFUL"), (2, "CURRENTLY_RATED_NOT_HELPFUL"), (3, "CURRENTLY_RATED_HELPFUL")], "noteId long, currentStatus string")
    n = spark.createDataFrame([(1, "w"), (2, None)], "noteId long, noteAuthorParticipantId string")
    core, notes = ratings.notes_slice(r, s, n, 2, 2)
    assert core.count() == 6 and sorted((x["noteId"], x["statusBinary"]) for x in notes.collect()) == [(1, 1), (2, 0)]
    assert {x["author_id"] for x in ratings.note_reactions(core, notes).collect()} == {"w", "anon:2"}


def message(did, op, collection, rkey, at, **record):
    return json.dumps({"did": did, "time_us": at, "kind": "commit", "commit": {"operation": op, "collection": collection, "rkey": rkey, "rev": "1", "record": record}})


MESSAGES = [
    message("d1", "create", firehose.POST, "p1", 1_000_000, createdAt="1970-01-01T00:00:05Z", text="hello"),
    message("d2", "create", firehose.LIKE, "l1", 2_000_000, subject={"uri": "at://d1/app.bsky.feed.post/p1"}),
    message("d3", "create", firehose.REPOST, "r1", 3_000_000, createdAt="nonsense", subject={"uri": "at://d1/app.bsky.feed.post/p1"}),
    message("d3", "create", firehose.LIKE, "l2", 3_000_000, subject={"uri": "at://d9/app.bsky.feed.generator/p1"}),
    message("d3", "delete", firehose.LIKE, "l1", 3_000_000),
    message("d1", "create", firehose.LIKE, "l3", 4_000_000, subject={"uri": "at://d2/app.bsky.feed.post/p2"}),
    "not json",
]


def test_messages(spark):
    m = firehose.parse_json(spark.createDataFrame([(x,) for x in MESSAGES], "value string"))
    assert m.count() == 6
    p = firehose.posts(m).collect()
    assert [(r["post_id"], r["created_at"], r["features"]["chars"]) for r in p] == [("at://d1/app.bsky.feed.post/p1", 5.0, 5.0)]
    assert sorted((r["user_id"], r["value"], r["timestamp"]) for r in firehose.reactions(m).collect()) == [("d1", 0.5, 4.0), ("d2", 0.5, 2.0), ("d3", 1.0, 3.0)]
    assert firehose.sampled(m, 0.0).count() == 0 and firehose.sampled(m, 1.0).count() == 6
    half = {r["did"] for r in firehose.sampled(m, 0.5).collect()}
    assert all(firehose.sampled(m, 0.5).filter(F.col("did") == d).count() == m.filter(F.col("did") == d).count() for d in half)


def test_service_loop_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(MESSAGES))
    now = [0.0]
    loop = service.WindowLoop(spark, str(tmp_path / "state"), Engine(Settings(d=1, mf_iterations=2)), clock=lambda: now[0])
    stream = service.message_stream(spark, str(tmp_path / "in"))
    loop.start(stream, str(tmp_path / "check")).awaitTermination()
    assert loop.read("posts").count() == 3 and loop.opened == 0.0 and loop.engine.fitted is None
    served = spark.createDataFrame([("d2", "at://d2/app.bsky.feed.post/p2", 0, "organic", 0.5), ("d2", "at://d1/app.bsky.feed.post/p1", 1, "organic", 0.5)], "user_id string, post_id string, slot int, source string, propensity double")
    loop.record_served(served, 0)
    now[0] = 1000.0
    (tmp_path / "in" / "b.json").write_text(message("d4", "create", firehose.LIKE, "l9", 5_000_000, subject={"uri": "at://d1/app.bsky.feed.post/p1"}))
    loop.start(stream, str(tmp_path / "check")).awaitTermination()
    assert loop.engine.fitted.scores.count() == 2 and loop.read("reactions") is None and loop.opened == 1000.0
    assert Engine.load(spark, str(tmp_path / "state" / "state"), loop.engine.settings).state["budgets"].count() == 2


def test_liked_posts_become_candidates(spark, tmp_path):
    hour, uri = 3600.0, "at://{}/app.bsky.feed.post/p".format
    now = [100 * hour]

    def like(did, key, at, target):
        return message(did, "create", firehose.LIKE, key, int(at * 1e6), subject={"uri": uri(target)})

    def batch(*lines):
        return firehose.parse_json(spark.createDataFrame([(x,) for x in lines], "value string"))

    loop = service.WindowLoop(spark, str(tmp_path), Engine(Settings(d=1, mf_iterations=2)), clock=lambda: now[0])
    old = message("old", "create", firehose.POST, "p", int(80 * hour * 1e6), text="x")
    loop.ingest(batch(old, like("u", "1", 99 * hour, "new"), like("u", "2", 99 * hour, "old"), like("u", "3", 0, "undated"), like("v", "4", 99.5 * hour, "new")), 0)
    loop.ingest(batch(like("w", "5", 98 * hour, "new")), 1)
    want = {uri("new"): 99 * hour, uri("undated"): 100 * hour}
    assert {r["post_id"]: r["created_at"] for r in service.live_candidates(loop.read("posts"), now[0]).collect()} == want
    loop.roll(now[0])
    assert {r["post_id"]: r["created_at"] for r in service.live_candidates(loop.read("posts"), now[0]).collect()} == want
    loop.ingest(batch(message("new", "create", firehose.POST, "p", int(97 * hour * 1e6), text="x")), 2)
    assert {r["post_id"]: r["created_at"] for r in service.live_candidates(loop.read("posts"), now[0]).collect()} == want | {uri("new"): 97 * hour}


def test_negatives_count_against_positive_reactions_only(spark):
    served = spark.createDataFrame([("u", "p"), ("u", "p"), ("u", "q"), ("v", "p")], "user_id string, post_id string")
    reacted = spark.createDataFrame([("u", "p", 0.5, None), ("u", "q", -1.0, "mute")], "user_id string, post_id string, value double, kind string")
    assert sorted((r["user_id"], r["post_id"]) for r in service.derived_negatives(served, reacted).collect()) == [("u", "q"), ("v", "p")]


def test_reordering_stream(spark, tmp_path):
    spark.createDataFrame([("k", 10, "a"), ("k", 5, "b"), ("k", 30, "c"), ("k", 25, "d")], "key string, at_us long, payload string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("key string, at_us long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = service.reordered(stream, 10).writeStream.format("memory").queryName("reordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame([("k", 7, "late"), ("k", 50, "z")], "key string, at_us long, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    rows = [(r["seq"], r["payload"], r["late"]) for r in spark.table("reordered").orderBy("seq").collect()]
    assert rows == [(0, "b", False), (1, "a", False)]


def test_window_counts_stream(spark, tmp_path):
    spark.createDataFrame([("u", 0.5, 10.0), ("u", 1.0, 20.0), ("v", 1.0, 2_000.0), ("v", 1.0, 0.0)], "user_id string, value double, timestamp double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id string, value double, timestamp double").parquet(str(tmp_path / "e"))
    for name, df in (("windows", service.window_counts(stream)), ("sessions", service.session_counts(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]
