"""Influence of raters: trust graph, quality tracking, scouts, recycling, and signs of collusion."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.operators.local import bounded, fetched, trust
from brindle.session import cut, replaced


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def trust_edges(authored: DataFrame, users: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """(src, dst, t): each rater's trust in authors who are raters too, summing to 1 per rater.

    authored: reactions with author_id. A positive reaction counts its value times the distance of the two in
    opinion space (1 where a coordinate is unknown). Edges are summed before the coordinates are joined.
    """
    raw = (
        authored.filter((F.col("value") > 0) & F.col("author_id").isNotNull() & (F.col("author_id") != F.col("user_id")))
        .groupBy(F.col("user_id").alias("src"), F.col("author_id").alias("dst"))
        .agg(F.sum("value").alias("v"))
        .join(users.select(F.col("user_id").alias("src")), "src", "left_semi")
        .join(users.select(F.col("user_id").alias("dst")), "dst", "left_semi")
    )
    if factors is not None:
        a = factors.select(F.col("user_id").alias("src"), F.col("x").alias("__xs"))
        b = factors.select(F.col("user_id").alias("dst"), F.col("x").alias("__xd"))
        raw = raw.join(a, "src", "left").join(b, "dst", "left")
        raw = raw.select("src", "dst", (F.col("v") * F.coalesce(distance(F.col("__xs"), F.col("__xd")), F.lit(1.0))).alias("v"))
    row = F.sum("v").over(Window.partitionBy("src"))
    return raw.withColumn("t", F.when(row > 0, F.col("v") / row).otherwise(F.col("v"))).select("src", "dst", "t")


def out_diversity(edges: DataFrame, floor: float = 0.0) -> DataFrame:
    """(src, w): entropy of a rater's trust over its largest possible value, in [floor, 1]; 0 for a single author."""
    t = F.when(F.col("t") > 0, F.col("t"))
    n = F.count(t)
    entropy = -F.sum(t * F.log(t))
    w = F.when(n > 1, entropy / F.log(n)).otherwise(0.0)
    return edges.groupBy("src").agg(F.least(F.greatest(F.lit(floor) + F.lit(1.0 - floor) * w, F.lit(0.0)), F.lit(1.0)).alias("w"))


def eigentrust(
    users: DataFrame,
    edges: DataFrame,
    s: Settings = Settings(),
    iterations: int | None = None,
    transmit: DataFrame | None = None,
    seeds: DataFrame | None = None,
    clip: float | None = None,
    local_rows: int = 0,
) -> DataFrame:
    """(user_id, lambda) summing to 1: trust flowing along edges, with teleport (1 - delta).

    transmit: (src, w) share of its weight a rater passes on. seeds: (user_id, p) teleport distribution (default
    uniform). clip: largest weight a rater may pass on, as a multiple of 1/n. With iterations None it runs until
    no weight moves by more than the tolerance; else exactly that often. What a step passes on is known before it, and
    so is the sum by which it is scaled. With local_rows, at most so many edges and raters are fetched and iterated in memory instead.
    """
    edges = edges if transmit is None else edges.join(transmit, "src").select("src", "dst", (F.col("t") * F.col("w")).alias("t"))
    edges = cut(edges.select("src", "dst", "t").filter(F.col("t") > 0))
    n = users.count()
    if not n:
        return users.select("user_id", F.lit(0.0).alias("lambda"))
    base = users.select("user_id") if seeds is None else users.select("user_id").join(seeds.select("user_id", "p"), "user_id", "left")
    tele = F.lit(1.0 / n) if seeds is None else F.coalesce("p", F.lit(0.0))
    given = edges.join(users.select(F.col("user_id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("user_id")).agg(F.sum("t").alias("out"))
    # out: the share of its weight a rater passes on to raters
    base = cut(base.select("user_id", tele.alias("p")).join(given, "user_id", "left").select("user_id", "p", F.coalesce("out", F.lit(0.0)).alias("out")))
    if n <= local_rows and bounded(edges, local_rows):
        return _trust_in_memory(base.select("user_id", "p"), edges, s, iterations, clip)

    def passed(weight: Column) -> Column:
        return F.least(weight, F.lit(clip / n)) if clip is not None else weight

    now, written = base.withColumn("lambda", F.lit(1.0 / n)), [base]
    seeded, flow = now.agg(F.sum("p"), F.sum(F.col("out") * passed(F.col("lambda")))).first()
    for _ in range(iterations if iterations is not None else s.trust_iterations):
        size = (1.0 - s.delta) * seeded + s.delta * flow or 1.0
        got = edges.join(now.select(F.col("user_id").alias("src"), passed(F.col("lambda")).alias("__l")), "src")
        got = got.groupBy(F.col("dst").alias("user_id")).agg(F.sum(F.col("t") * F.col("__l")).alias("__in"))
        new = (F.lit(1.0 - s.delta) * F.col("p") + F.lit(s.delta) * F.coalesce("__in", F.lit(0.0))) / F.lit(size)
        moved = F.abs(new - F.col("lambda"))
        now = replaced(cut(now.join(got, "user_id", "left").select("user_id", "p", "out", new.alias("lambda"), moved.alias("moved"))), *written)
        written = [now]
        flow, most = now.agg(F.sum(F.col("out") * passed(F.col("lambda"))), F.max("moved")).first()
        if iterations is None and most < s.trust_tolerance:
            break
    return now.select("user_id", "lambda")


def _trust_in_memory(base: DataFrame, edges: DataFrame, s: Settings, iterations: int | None, clip: float | None) -> DataFrame:
    nodes, rows = fetched(base), fetched(edges)
    index = pd.Index(nodes["user_id"])
    src, dst = index.get_indexer(rows["src"]), index.get_indexer(rows["dst"])
    ok = (src >= 0) & (dst >= 0)
    steps, tolerance = (s.trust_iterations, s.trust_tolerance) if iterations is None else (iterations, None)
    weights = trust(src[ok], dst[ok], rows["t"].to_numpy(float)[ok], nodes["p"].to_numpy(float), s.delta, steps, tolerance, clip)
    kind = base.schema["user_id"].dataType.simpleString()
    return base.sparkSession.createDataFrame(pd.DataFrame({"user_id": nodes["user_id"], "lambda": weights}), f"user_id {kind}, lambda double")


def ring(edges: DataFrame, puppets: DataFrame, target: str) -> DataFrame:
    """The trust graph with puppet raters who trust a single target."""
    return edges.unionByName(puppets.select(F.col("user_id").alias("src"), F.lit(target).alias("dst"), F.lit(1.0).alias("t")))


def percentile_of(weights: DataFrame, user_id: str) -> DataFrame:
    """Share of raters with less influence than one rater, in percent."""
    own = weights.filter(F.col("user_id") == user_id).agg(F.max("lambda").alias("l")).scalar()
    return weights.agg((F.avg(F.when(F.col("lambda") < own, 100.0).otherwise(0.0))).alias("percentile"))


def quality_weight(adjusted: DataFrame, delta: float = 0.85) -> DataFrame:
    """(user_id, quality) summing to 1: positive part of each rater's correlation with the posts' bridged quality.

    adjusted: (user_id, adj, b_p). Raters with fewer than two reactions or without spread stand at the floor 1 - delta.
    Moments are taken around each rater's mean in a second pass over few numbers, never by corr, which divides by 0.
    """
    floor = 1.0 - delta
    means = adjusted.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("adj").alias("sa"), F.stddev_pop("b_p").alias("sb"), F.covar_pop("adj", "b_p").alias("c")
    )
    r = F.when((F.col("n") >= 2) & (F.col("sa") >= 1e-9) & (F.col("sb") >= 1e-9), F.col("c") / (F.col("sa") * F.col("sb")))
    rows = means.select("user_id", (F.lit(floor) + F.lit(1.0 - floor) * F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(0.0))).alias("q"))
    total = rows.agg(F.sum("q").alias("t")).scalar()
    return rows.select("user_id", (F.col("q") / total).alias("quality"))


def blend(trust: DataFrame, quality: DataFrame, mix: float = 0.5) -> DataFrame:
    """(user_id, lambda) summing to 1: mix of the two weightings over all raters of either."""
    both = trust.join(quality, "user_id", "full_outer").select(
        "user_id",
        (F.lit(1.0 - mix) * F.coalesce("lambda", F.lit(0.0)) + F.lit(mix) * F.coalesce("quality", F.lit(0.0))).alias("l"),
    )
    total = both.agg(F.sum("l").alias("t")).scalar()
    return both.select("user_id", F.when(total > 0, F.col("l") / total).otherwise(F.col("l")).alias("lambda"))


def scout_precision(reactions: DataFrame, strength: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(user_id, scout): strength of the posts a user approved, weighted by how early.

    The k-th approval of a post weighs exp(-alpha k). Only the early ones weigh anything: past k = 745.14 / alpha the
    weight is below the smallest double. The rank is thus taken among a post's first approvals only, found without
    sorting the whole post: slices of the post's approvals are ranked apart and their heads merged. Users whose
    approvals all come later stand at 0.
    """
    picks = reactions.filter(F.col("value") > 0).join(strength.select("post_id", "strength"), "post_id")
    order = [F.col("ts").asc(), F.col("ordinal").asc()]
    if alpha <= 0:
        ranked = picks.withColumn("__d", F.lit(1.0))
    else:
        head = int(745.14 / alpha) + 1
        slice_ = F.pmod(F.xxhash64("ordinal"), F.lit(64))
        first = picks.withColumn("__slice", slice_).withColumn("__k", F.row_number().over(Window.partitionBy("post_id", "__slice").orderBy(*order)))
        near = first.filter(F.col("__k") <= head).withColumn("__k", F.row_number().over(Window.partitionBy("post_id").orderBy(*order)) - 1)
        ranked = near.withColumn("__d", F.exp(F.lit(-alpha) * F.col("__k")))
    early = ranked.select("user_id", (F.col("__d") * F.col("strength")).alias("a"), F.col("__d").alias("b"))
    everyone = picks.select("user_id").distinct().select("user_id", F.lit(None).cast("double").alias("a"), F.lit(0.0).alias("b"))
    sums = early.unionByName(everyone).groupBy("user_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("user_id", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("scout"))


def satisfaction(aligned: DataFrame) -> DataFrame:
    """(user_id, satisfaction): mean alignment xy of what a user reacted to; rows without alignment don't count."""
    return aligned.filter(F.col("xy").isNotNull()).groupBy("user_id").agg(F.avg("xy").alias("satisfaction"))


def verified_satisfaction(aligned: DataFrame) -> DataFrame:
    """Satisfaction credited only as far as exploration confirms it; aligned: (user_id, source, xy)."""
    explored = F.coalesce(F.col("source") == "exploration", F.lit(False))
    rows = aligned.filter(F.col("xy").isNotNull()).groupBy("user_id").agg(
        F.avg(F.when(~explored, F.col("xy"))).alias("org"), F.avg(F.when(explored, F.col("xy"))).alias("eps")
    ).filter(F.col("org").isNotNull())
    bar = rows.agg(F.avg("org").alias("m")).scalar()
    rows = rows.withColumn("__bar", bar)
    gap = F.coalesce("eps", "__bar") - F.col("org")
    return rows.select("user_id", (F.col("__bar") - F.greatest(gap, F.lit(0.0))).alias("satisfaction"))


def recycle(weights: DataFrame, realised: DataFrame, zeta: float = 0.3) -> DataFrame:
    """(user_id, lambda): influence moved from the well served to the others; its sum stays the same."""
    bar = realised.agg(F.avg("satisfaction").alias("m")).scalar()
    rows = weights.join(realised, "user_id", "left").withColumn("__bar", bar)
    factor = F.greatest(1.0 + F.lit(zeta) * (F.col("__bar") - F.coalesce("satisfaction", "__bar")), F.lit(0.0))
    moved = rows.select("user_id", F.col("lambda").alias("__l"), (F.col("lambda") * F.coalesce(factor, F.lit(1.0))).alias("__m"))
    scale = moved.agg((F.try_divide(F.sum("__l"), F.when(F.sum("__m") > 0, F.sum("__m")))).alias("s")).scalar()
    return moved.select("user_id", (F.col("__m") * F.coalesce(scale, F.lit(1.0))).alias("lambda"))


# ---------------------------------------------------------------------------------------------
# collusion


def coordination(reactions: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(post_id, coordination): mean Jaccard similarity of the approval sets of a post's approvers, pair by pair.

    By definition only a post's first `most` approvers are looked at, which bounds the pairs of a post; posts with
    fewer than `least` approvers score 0. The overlaps are taken over the whole approval sets.
    """
    approved = reactions.filter(F.col("value") > 0).groupBy("user_id", "post_id").agg(F.min("ordinal").alias("first"))
    # heads of slices first, so that no task sorts all approvers of a hot post
    sliced = approved.withColumn("__s", F.pmod(F.xxhash64("user_id"), F.lit(64)))
    near = sliced.withColumn("__k", F.row_number().over(Window.partitionBy("post_id", "__s").orderBy("first"))).filter(F.col("__k") <= most)
    head = near.withColumn("__k", F.row_number().over(Window.partitionBy("post_id").orderBy("first"))).filter(F.col("__k") <= most)
    sizes = head.groupBy("post_id").agg(F.count(F.lit(1)).alias("k"))
    sets = approved.groupBy("user_id").agg(F.collect_list("post_id").alias("posts"))
    a = head.select("post_id", F.col("user_id").alias("u"), F.col("__k").alias("ku"))
    b = head.select("post_id", F.col("user_id").alias("v"), F.col("__k").alias("kv"))
    pairs = a.join(b, "post_id").filter(F.col("ku") < F.col("kv"))
    distinct = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    similar = (
        distinct.join(sets.select(F.col("user_id").alias("u"), F.col("posts").alias("pu")), "u")
        .join(sets.select(F.col("user_id").alias("v"), F.col("posts").alias("pv")), "v")
        .withColumn("c", F.size(F.array_intersect("pu", "pv")))
        .select("u", "v", (F.col("c") / (F.size("pu") + F.size("pv") - F.col("c"))).alias("j"))
    )
    keyed = pairs.select("post_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    means = keyed.join(similar, ["u", "v"]).groupBy("post_id").agg(F.avg("j").alias("j"))
    return sizes.join(means, "post_id", "left").select(
        "post_id", F.when(F.col("k") < least, 0.0).otherwise(F.coalesce("j", F.lit(0.0))).alias("coordination")
    )


def support(authored: DataFrame) -> DataFrame:
    """(author_id, user_id, support): positive reactions of a rater to an author in a window."""
    return authored.filter((F.col("value") > 0) & F.col("author_id").isNotNull()).groupBy("author_id", "user_id").agg(
        F.count(F.lit(1)).cast("double").alias("support")
    )


def manufactured_fraction(supported: DataFrame, coordinates: DataFrame | None = None, evidence: float = 2.0) -> DataFrame:
    """(author_id, fraction): share of an author's support that comes from a loyal, opinion-dispersed bloc.

    Loyalty is support relative to the most loyal rater; raters below `evidence` don't count. The share is scaled by
    the bloc's spread on the opinion axis (coordinates: user_id, x) over the population's, at most 1.
    """
    s = F.col("support")
    top = supported.groupBy("author_id").agg(F.max(s).alias("top"), F.sum(s).alias("total"))
    rows = supported.join(top, "author_id").withColumn("m", F.when(s >= evidence, s * s / F.col("top")))
    if coordinates is None:
        sums = rows.groupBy("author_id").agg(F.first("total").alias("total"), F.first("top").alias("top"), F.sum("m").alias("mass"))
        spread = F.lit(1.0)
    else:
        pop = coordinates.agg(F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
        sd = pop.select(F.when((F.col("n") >= 2) & (F.col("sd") > 1e-9), F.col("sd"))).scalar()
        rows = rows.join(coordinates.select("user_id", "x"), "user_id", "left")
        w = F.when(F.col("x").isNotNull(), F.col("m"))
        sums = rows.groupBy("author_id").agg(
            F.first("total").alias("total"),
            F.first("top").alias("top"),
            F.sum("m").alias("mass"),
            F.count("m").alias("k"),
            F.count(w).alias("kx"),
            F.sum(w).alias("w"),
            F.sum(w * F.col("x")).alias("wx"),
            F.sum(w * F.col("x") * F.col("x")).alias("wxx"),
        ).withColumn("__sd", sd)
        mean = F.col("wx") / F.col("w")
        wide = F.sqrt(F.greatest(F.col("wxx") / F.col("w") - mean * mean, F.lit(0.0)))
        judged = (F.col("k") >= 2) & (F.col("kx") >= 2) & (F.col("w") > 0) & F.col("__sd").isNotNull()
        spread = F.when(judged, F.least(F.lit(1.0), wide / F.col("__sd"))).otherwise(1.0)
    fraction = F.when((F.col("total") > 0) & (F.col("top") >= evidence), F.coalesce("mass", F.lit(0.0)) / F.col("total") * spread).otherwise(0.0)
    return sums.select("author_id", fraction.alias("fraction"))


def penalise(scores: DataFrame, parts: list[tuple[DataFrame, str, str, float]]) -> DataFrame:
    """Scores less weight * column of each part (rows, key, column, weight), in order; absent rows cost nothing."""
    def one(acc: DataFrame, part) -> DataFrame:
        rows, key, column, weight = part
        held = rows.select(key, F.col(column).alias("__p"))
        return acc.join(held, key, "left").withColumn("b_lcb", F.col("b_lcb") - F.lit(weight) * F.coalesce("__p", F.lit(0.0))).drop("__p")

    return reduce(one, parts, scores)
