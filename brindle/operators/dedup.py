"""Messages delivered more than once: exactly one copy of each, over one delivery or many.

Identifiers are encoded exactly as (page, code). A message its producer numbered keeps the number as code, on the
producer's page; any other identifier gets its code from a dictionary: the next free number on the page of the delivery
that brought it first. The codes seen so far are bitmaps of 32,768 bits, sharded by page and code and compressed
where they are kept. Of a delivery one arrival is selected for each code whose bit is not set, and the new bits are
united with the old ones in one atomic step (`SeenStore`).

Defined cases: null parts of an identifier are values like any other (two nulls are the same); NaN equals
NaN; among equal arrivals the lowest arrival number is kept; rows repeated under one arrival number count
once; empty input gives empty output; the columns of the rows are never touched, whatever their names.
A message repeated without bound is no burden: copies are folded before the first shuffle.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_dir


def first_arrivals(rows: DataFrame, identifier: Sequence[str], arrival: str) -> DataFrame:
    """identifier + arrival of the first copy. Partial aggregation folds hot identifiers before the shuffle."""
    return rows.groupBy(*identifier).agg(F.min(arrival).alias(arrival))


def _bucket(code: Column) -> Column:
    return F.bitmap_bucket_number(code)


def bitmaps(codes: DataFrame, code: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, bucket, bits): bitmaps over a column of codes.

    The codes are first brought together by bucket, so that no task holds the bitmaps of all buckets.
    """
    return (
        codes.select(*by, F.col(code).alias("__code"), _bucket(F.col(code)).alias("bucket"))
        .repartition(*by, "bucket")
        .groupBy(*by, "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__code")).alias("bits"))
    )


def united(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, bucket, bits): the union of bitmaps of the same bucket."""
    return parts.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_is_set(bits: Column, code: Column) -> Column:
    """Whether a bitmap made by `bitmaps` holds the code."""
    position = F.bitmap_bit_position(code)
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("bit_get", byte, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))


def marked(rows: DataFrame, code: str, seen: DataFrame, by: Sequence[str] = (), spread: Column | None = None) -> DataFrame:
    """rows + __seen: whether the row's code is set in the bitmaps `seen` (as made by `bitmaps`).

    Never by broadcast: compressed bitmaps look many times smaller than they are. Rows without a code meet no bitmap;
    a hash of each such row, `spread`, keeps them from coming together in one task.
    """
    held = seen.select(*[F.col(c).alias(f"__s_{c}") for c in by], F.col("bucket").alias("__s_bucket"), F.col("bits").alias("__s_bits"))
    bucket = _bucket(F.col(code))
    if spread is not None:  # below every bucket of a code
        bucket = F.coalesce(bucket, F.lit(-(1 << 62)) + F.pmod(spread, F.lit(1 << 40)))
    rows = rows.withColumn("__bucket", bucket)
    on = F.col("__bucket") == F.col("__s_bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    out = rows.join(held.hint("merge"), on, "left").withColumn("__seen", bit_is_set(F.col("__s_bits"), F.col(code)))
    return out.drop("__bucket", "__s_bucket", "__s_bits", *[f"__s_{c}" for c in by])


def all_but(kept: DataFrame, arrivals: DataFrame, by: str, arrival: str) -> DataFrame:
    """(by, arrival) of the arrivals that are not among the kept ones, found by a bitmap over arrival numbers."""
    return marked(arrivals.select(by, arrival), arrival, bitmaps(kept, arrival, [by]), [by]).filter(~F.col("__seen")).select(by, arrival)


def redundant_arrivals(parts: Sequence[tuple[DataFrame, Sequence[str]]], arrivals: DataFrame, by: str, arrival: str) -> DataFrame:
    """(by, arrival) of every copy but the first, for a single delivery without a store.

    parts: disjoint sets of rows, each with the columns that identify its messages; arrivals: (by, arrival) of
    all rows of the parts.
    """
    kept = None
    for rows, identifier in parts:
        one = first_arrivals(rows, [by, *[c for c in identifier if c != by]], arrival).select(by, arrival)
        kept = one if kept is None else kept.unionByName(one)
    return all_but(kept, arrivals, by, arrival)


# ---------------------------------------------------------------------------------------------
# identifiers of the two logs

#: Columns of a message of either log: `shard` and `msg_id` name it where its producer numbered it, else those of PLAIN.
NUMBERED, NUMBER, PLAIN = ("src", "shard"), "msg_id", ("src", "a", "b", "c", "d", "t")


def commit_messages(firehose: DataFrame) -> DataFrame:
    """(src, row_id, did, rev, collection, rkey) of the commits; other kinds are never repeated."""
    return firehose.filter(F.col("kind") == "commit").select(
        F.lit("firehose").alias("src"),
        F.col("row_id"),
        F.col("did"),
        F.col("commit.rev").alias("rev"),
        F.col("commit.collection").alias("collection"),
        F.col("commit.rkey").alias("rkey"),
    )


def reaction_messages(reactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered reactions (src, row_id, shard, msg_id) and the others (src, row_id, user_id, post_id, kind, timestamp)."""
    base = reactions.withColumnsRenamed({"ordinal": "row_id"}).withColumn("src", F.lit("reactions"))
    numbered = base.filter(F.col("msg_id").isNotNull()).select("src", "row_id", "shard", "msg_id")
    plain = base.filter(F.col("msg_id").isNull()).select("src", "row_id", "user_id", "post_id", "kind", "timestamp")
    return numbered, plain


def messages(firehose: DataFrame, reactions: DataFrame) -> DataFrame:
    """(src, row_id, shard, msg_id, a, b, c, d, t) of both logs, each read once."""
    commits = commit_messages(firehose).select(
        "src", "row_id", F.lit(None).cast("string").alias("shard"), F.lit(None).cast("long").alias("msg_id"),
        F.col("did").alias("a"), F.col("rev").alias("b"), F.col("collection").alias("c"), F.col("rkey").alias("d"), F.lit(None).cast("double").alias("t"),
    )
    reacted = reactions.select(
        F.lit("reactions").alias("src"), F.col("ordinal").alias("row_id"), "shard", "msg_id",
        F.col("user_id").alias("a"), F.col("post_id").alias("b"), F.col("kind").alias("c"), F.lit(None).cast("string").alias("d"), F.col("timestamp").alias("t"),
    )
    return commits.unionByName(reacted)


def deliveries(rows: DataFrame, number: str, parts: int) -> list[DataFrame]:
    """The rows in consecutive parts of about the same span of a number that grows from delivery to delivery."""
    low, high = rows.agg(F.min(number), F.max(number)).first()
    if low is None or parts <= 1:
        return [rows]
    edges = [low + (high - low) * k // parts for k in range(1, parts)]
    inner = [rows.filter((F.col(number) > a) & (F.col(number) <= b)) for a, b in zip(edges, edges[1:])]
    return [rows.filter(F.col(number).isNull() | (F.col(number) <= edges[0])), *inner, rows.filter(F.col(number) > edges[-1])]


def redundant_messages(firehose: DataFrame, reactions: DataFrame, parts: int = 3) -> DataFrame:
    """(src, row_id) of every redundant copy in both logs, which the store takes in as `parts` deliveries.

    What a delivery repeats of an earlier one is told by the seen bits; the row numbers grow with the deliveries.
    """
    store = SeenStore(firehose.sparkSession)
    logs = zip(deliveries(firehose, "row_id", parts), deliveries(reactions, "ordinal", parts)) if parts > 1 else [(firehose, reactions)]
    for f, r in logs:
        store.ingest(messages(f, r), NUMBERED, "row_id", NUMBER, PLAIN)
    kept = store.kept()
    commits = firehose.filter(F.col("kind") == "commit").select(F.lit("firehose").alias("src"), "row_id")
    arrivals = commits.unionByName(reactions.select(F.lit("reactions").alias("src"), F.col("ordinal").alias("row_id")))
    return all_but(kept, arrivals, "src", "row_id")


# ---------------------------------------------------------------------------------------------
# over many deliveries


class SeenStore:
    """Exactly-once over deliveries: an append-only dictionary of identifiers and the bitmaps of seen codes.

    A delivery writes a folder of its own beside the earlier ones and becomes current by one rename that fails where
    the version is already taken, so a delivery is counted wholly or not at all and of two at once only one is; a
    delivery given again keeps nothing. Bitmaps are appended as the new bits only and united every `COMPACT` versions,
    then in `shards` files.
    """

    POINTER, COMPACT = "current", 8

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64):
        self.spark, self.shards = spark, shards
        self.path = path or os.path.join(shared_dir(spark), f"seen-{uuid.uuid4().hex}")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> dict:
        fs, Path = self._fs()
        found = fs.globStatus(Path(f"{self.path}/{self.POINTER}-*.json"))
        names = sorted(f.getPath().toString() for f in found) if found else []
        if not names:
            return {"version": 0, "messages": [], "bitmaps": []}
        return json.loads(self.spark.read.text(names[-1]).first()[0])

    def _publish(self, state: dict) -> None:
        """One rename makes the version current, unless another delivery took it: the highest pointer counts."""
        fs, Path = self._fs()
        temporary, to = Path(f"{self.path}/.{uuid.uuid4().hex}"), Path(f"{self.path}/{self.POINTER}-{state['version']:012d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        spark = self.spark.sparkContext
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        none = spark._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), hadoop).rename(temporary, to, none)
        except Exception as e:
            fs.delete(temporary, False)
            if fs.exists(to):
                raise RuntimeError("another delivery published this version first") from e
            raise

    def ingest(self, rows: DataFrame, identifier: Sequence[str], arrival: str, number: str | None = None, plain: Sequence[str] = ()) -> DataFrame:
        """(*identifier parts under their names, arrival) of the messages of `rows` not seen before; the state then holds them.

        With `number`, identifier + number name a message where there is a number, and the number itself is the code;
        where there is none, `plain` names it. Without, `identifier` does, and codes come from the dictionary. Of the
        plain columns those that are in the identifier too are returned from there.
        """
        state = self.current()
        version = state["version"] + 1
        to = f"{self.path}/v{version}-{uuid.uuid4().hex}"
        kinds = dict(rows.dtypes)
        own = F.col(number).isNotNull() if number else F.lit(False)
        coded = list(plain) if number else list(identifier)
        left = [F.when(own, F.col(c)).alias(f"n_{c}") for c in identifier] if number else [F.lit(None).cast("string").alias("n_")]
        right = [F.when(~own, F.col(c)).alias(f"p_{c}") for c in coded]
        numeral = (F.col(number) if number else F.lit(None)).cast("long").alias("number")
        # one copy of each identifier; a struct is one key, in which null equals null
        folded = rows.groupBy(F.struct(*left, numeral, *right).alias("id")).agg(F.min(arrival).alias(arrival))
        known = self._read(state["messages"])
        if known is not None and coded:
            dictionary = known.filter(F.col("id.number").isNull()).select(F.col("id").alias("__known"), F.col("page.delivery").alias("__delivery"), F.col("code").alias("__code"))
            folded = folded.join(dictionary, F.col("id") == F.col("__known"), "left").drop("__known")
        else:
            folded = folded.withColumns({"__delivery": F.lit(None).cast("int"), "__code": F.lit(None).cast("long")})
        page = F.struct(*[F.col(f"id.n_{c}").alias(f"n_{c}") for c in (identifier if number else [""])], F.col("__delivery").alias("delivery"))
        encoded = folded.select("id", page.alias("page"), F.coalesce("id.number", "__code").alias("code"), arrival)
        seen = self._read(state["bitmaps"])
        if seen is not None:
            encoded = marked(encoded, "code", united(seen, ["page"]), ["page"], F.xxhash64("id")).filter(~F.col("__seen")).drop("__seen")
        # new identifiers get the next numbers of this delivery's page; as written they are final
        fresh = F.col("code").isNull()
        new = encoded.select(
            "id",
            F.when(fresh, F.col("page").withField("delivery", F.lit(version))).otherwise(F.col("page")).alias("page"),
            F.coalesce("code", F.monotonically_increasing_id()).alias("code"),
            arrival,
        )
        new.write.option("compression", "zstd").parquet(f"{to}/messages")
        written = self.spark.read.parquet(f"{to}/messages")
        bitmaps(written, "code", ["page"]).write.option("compression", "zstd").parquet(f"{to}/bitmaps")
        held = [*state["bitmaps"], f"{to}/bitmaps"]
        if len(held) >= self.COMPACT:
            united(self._read(held), ["page"]).repartition(self.shards, "page", "bucket").write.option("compression", "zstd").parquet(f"{to}/united")
            held = [f"{to}/united"]
        self._publish({"version": version, "messages": [*state["messages"], f"{to}/messages"], "bitmaps": held})
        return self._arrivals(written, kinds, arrival)

    def kept(self) -> DataFrame:
        """The arrivals selected over all deliveries, with the parts of their identifiers that every message has."""
        found = self._read(self.current()["messages"])
        arrival = next(c for c in found.columns if c not in ("id", "page", "code"))
        return self._arrivals(found, {}, arrival)

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    @staticmethod
    def _arrivals(written: DataFrame, kinds: dict, arrival: str) -> DataFrame:
        parts = [f.name for f in written.schema["id"].dataType.fields]
        both = [c[2:] for c in parts if c.startswith("n_") and f"p_{c[2:]}" in parts]
        return written.select(*[F.coalesce(f"id.n_{c}", f"id.p_{c}").alias(c) for c in both], arrival)
