"""Evaluation: ranks, correlations, ranking quality, agreement of clusterings, cores of bipartite graphs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.skew import cumulated
from brindle.session import cut


def value_ranks(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, value, c, rank): distinct values with their number of rows and average rank (1-based, ties share).

    Equal values are folded first; no task sorts a whole group (see `cumulated`).
    """
    by = list(by)
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.select(F.struct(*by).alias("key") if by else F.lit(0).alias("key"), F.col(value).alias("value"), "n")
    ranked = cumulated(pairs)
    mean = F.col("run") - F.col("n") + (F.col("n") + 1) / 2.0
    return ranked.select(*[F.col(f"key.{c}").alias(c) for c in by], F.col("value").alias(value), F.col("n").alias("c"), mean.alias("rank"))


def average_ranks(rows: DataFrame, value: str, to: str, by: Sequence[str] = ()) -> DataFrame:
    """rows + the average rank of a value among its group's; rows without a value are left out."""
    ranks = value_ranks(rows.filter(F.col(value).isNotNull()), value, by)
    ranks = ranks.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(value).alias("__value"), F.col("rank").alias(to))
    on = F.col(value) == F.col("__value")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(ranks, on).drop("__value", *[f"__{c}" for c in by])


def guarded_corr(a: Column, b: Column) -> Column:
    """Correlation as an aggregate; 0 where either side has no spread."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 0) & (sb > 0), F.covar_pop(a, b) / (sa * sb)).otherwise(0.0)


def spearman(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, a, "__ra", by), b, "__rb", by)
    return ranked.groupBy(*by).agg(guarded_corr(F.col("__ra"), F.col("__rb")).alias("spearman"))


def auc(rows: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, auc) by ranks; 0.5 where a class is empty."""
    ranked = average_ranks(rows, score, "__r", by)
    p, n = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    u = F.sum(F.when(F.col(label) == 1, F.col("__r")).otherwise(0.0)) - p * (p + 1) / 2.0
    return ranked.groupBy(*by).agg(F.when((p > 0) & (n > 0), u / (p * n)).otherwise(0.5).alias("auc"))


def ndcg_at_k(rows: DataFrame, group: str, score: str, relevance: str, tie: str, k: int) -> DataFrame:
    """(group, ndcg) of the first k by score (ties by `tie`) against the best k; 0 where nothing is relevant."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("__i", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("__j", F.row_number().over(w.orderBy(F.desc(relevance), tie)))

    def gain(i: str) -> Column:
        return F.sum(F.when(F.col(i) <= k, F.col(relevance) / F.log2(F.col(i) + 1.0)).otherwise(0.0))

    return ranked.groupBy(group).agg(gain("__i").alias("d"), gain("__j").alias("best")).select(
        group, F.when(F.col("best") != 0, F.col("d") / F.col("best")).otherwise(0.0).alias("ndcg")
    )


def adjusted_rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement of two labelings beyond chance, from one pass over grouping sets."""
    def pairs(x: Column) -> Column:
        return x * (x - 1) / 2.0

    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sums = cells.groupingSets([[a, b], [a], [b], []], a, b).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    s = sums.agg(*[F.sum(F.when(F.col("g") == g, pairs(F.col("n"))).otherwise(0.0)).alias(name) for g, name in ((0, "c"), (1, "pa"), (2, "pb"), (3, "t"))])
    expected = F.col("pa") * F.col("pb") / F.col("t")
    most = (F.col("pa") + F.col("pb")) / 2.0
    return s.select(F.when(F.col("t") > 0, F.when(most != expected, (F.col("c") - expected) / (most - expected)).otherwise(1.0)).otherwise(1.0).alias("ari"))


def embedding_recovery(pairs: DataFrame, blocks: int = 16) -> DataFrame:
    """One row: correlation of the pairwise distances of users in two geometries; NULL for fewer than 4 users.

    pairs: (user_id, est ARRAY, true ARRAY). Distances are taken between blocks of users, each pair of blocks in a task
    of its own that returns six sums; choose blocks so that a block of users fits a task.
    """
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    rows = pairs.withColumn("b", block)
    to = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    spread = rows.select("b", "est", "true", F.explode(F.array_distinct(to)).alias("p")).select("b", "est", "true", "p.i", "p.j")

    def sums(p: pd.DataFrame) -> pd.DataFrame:
        i, j = int(p["i"].iloc[0]), int(p["j"].iloc[0])
        left, right = p[p["b"] == i], p[p["b"] == j]
        if left.empty or right.empty:
            return pd.DataFrame([[0.0] * 6], columns=list("nxyabc"))

        def far(c: str) -> np.ndarray:
            u, v = np.stack(left[c].to_list()), np.stack(right[c].to_list())
            d = np.sqrt(np.maximum(((u[:, None, :] - v[None, :, :]) ** 2).sum(-1), 0.0))
            return d[np.triu_indices(len(u), k=1)] if i == j else d.ravel()

        x, y = far("est"), far("true")
        return pd.DataFrame([[float(len(x)), x.sum(), y.sum(), x @ x, y @ y, x @ y]], columns=list("nxyabc"))

    got = spread.groupBy("i", "j").applyInPandas(sums, "n double, x double, y double, a double, b double, c double")
    t = got.agg(*[F.sum(k).alias(k) for k in "nxyabc"])
    n = F.col("n")
    vx, vy = F.col("a") / n - (F.col("x") / n) ** 2, F.col("b") / n - (F.col("y") / n) ** 2
    ok = (n >= 6) & (vx > 1e-24) & (vy > 1e-24)
    return t.select(F.when(ok, (F.col("c") / n - F.col("x") * F.col("y") / n / n) / F.sqrt(vx * vy)).alias("recovery"))


def finite_mean(x: Column) -> Column:
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def kcore(edges: DataFrame, left: str, right: str, least_left: int, least_right: int) -> DataFrame:
    """The edges of the bipartite core in which every left and right node keeps enough edges; each round is written."""
    now = cut(edges)
    n = now.count()
    while True:
        for key, least in ((left, least_left), (right, least_right)):
            enough = now.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(key)
            now = now.join(enough, key, "left_semi")
        now = cut(now)
        left_over = now.count()
        if left_over == n:
            return now
        n = left_over


def dense_slice(reactions: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """Reactions of the most active users on the most frequent items among them (ties by id)."""
    users = reactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(n_users)
    some = reactions.join(users.select("user_id"), "user_id", "left_semi")
    items = some.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "post_id").limit(n_items)
    return some.join(items.select("post_id"), "post_id", "left_semi")


def balanced_auc(rows: DataFrame, score: str, label: str, key: str, draws: int = 25, seed: int = 0) -> DataFrame:
    """One row: mean AUC, to nine digits, over draws that take as many of the larger class as the smaller has (by hash of key and draw).

    The smaller class is whole in every draw, so what a row of the larger one adds to the AUC (the share of the smaller
    that its score beats, ties half) is the same in each draw: rows are read with that share, and a draw is a sum over
    the rows up to its last hash. That one is found by counts of the hashes' leading digits and the order of the
    few rows that share the digits in question; no draw is dealt out as rows.
    """
    pos = F.coalesce(F.col(label) == 1, F.lit(False))
    held = cut(rows.select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), pos.alias("pos")))
    sizes = {r["pos"]: (r["n"], r["known"]) for r in held.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("known")).collect()}
    if len(sizes) < 2:
        return held.sparkSession.createDataFrame([(0.5 if sizes else None,)], "balanced_auc double")
    small = min(sizes, key=lambda x: sizes[x][0])
    least, known = sizes[small]
    per_score = held.filter("score IS NOT NULL").groupBy("score").agg(F.sum((F.col("pos") == F.lit(small)).cast("long")).alias("n"))
    beaten = cumulated(per_score.select(F.lit(0).alias("key"), F.col("score").alias("value"), "n"))
    beaten = beaten.select(F.col("value").alias("score"), (F.col("run") - F.col("n") / 2.0).alias("beaten"))
    large = held.filter(F.col("pos") != F.lit(small))

    # three digits at most: a task's counts are 4096 a draw
    digits = min(3, max(1, round(math.log(max(sizes[not small][0] / 256, 1), 16))))
    head = F.substring("hash", 1, digits)

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """columns + draw, hash: each row in each draw, to be reduced where it is made."""
        hashes = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.md5(F.concat_ws("|", F.col("key").cast("string"), k.cast("string"), F.lit(str(seed)))))
        return rows.select(*columns, F.posexplode(hashes).alias("draw", "hash"))

    counts = dealt(large).groupBy("draw", head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("run", F.sum("n").over(Window.partitionBy("draw").orderBy("head")))
    last = counts.filter((F.col("run") >= least) & (F.col("run") - F.col("n") < least)).collect()
    ends = F.create_map(*[F.lit(x) for r in last for x in (r["draw"], r["head"])])[F.col("draw")]
    missing = F.create_map(*[F.lit(x) for r in last for x in (r["draw"], least - (r["run"] - r["n"]))])[F.col("key")]
    whole = dealt(large.join(beaten, "score"), "key", "beaten").filter(head < ends).groupBy("draw").agg(F.sum("beaten").alias("beaten"), F.count(F.lit(1)).alias("n"))
    # the rows that share the digits of a draw's last row, in the draw's order
    near = dealt(large, "key", "score").filter(head == ends).groupBy(F.col("draw").alias("key"), F.struct("hash", "key", "score").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    taken = F.least(F.col("n"), F.greatest(missing - (F.col("run") - F.col("n")), F.lit(0)))
    near = cumulated(near).select(F.col("key").alias("draw"), F.col("value.score").alias("score"), taken.alias("n")).filter("n > 0").join(beaten, "score")
    near = near.groupBy("draw").agg(F.sum(F.col("n") * F.col("beaten")).alias("beaten"), F.sum("n").alias("n"))
    share = F.sum("beaten") / F.sum("n") / F.lit(float(known))
    found = whole.unionByName(near).groupBy("draw").agg((1.0 - share if small else share).alias("auc"))
    return found.agg(F.round(F.coalesce(F.avg("auc"), F.lit(0.5)), 9).alias("balanced_auc"))


def churn(feeds: DataFrame) -> DataFrame:
    """(user_id, window, churn): 1 - Jaccard similarity of a viewer's feed with that of the window before."""
    # by rows of (viewer, post, window), so that no viewer's feeds are gathered
    shown = feeds.select("user_id", "window", "post_id").distinct()
    sizes = shown.groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("user_id").orderBy("window")
    sizes = sizes.withColumn("before", F.lag("window").over(along)).withColumn("m", F.lag("n").over(along)).filter(F.col("before").isNotNull())
    # a post stays if the same viewer was shown it in the window before
    last = Window.partitionBy("user_id", "post_id").orderBy("window")
    kept = shown.withColumn("before", F.lag("window").over(last)).filter(F.col("before").isNotNull())
    stayed = sizes.select("user_id", "window", "before").join(kept, ["user_id", "window", "before"]).groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("both"))
    both = F.coalesce("both", F.lit(0))
    union = F.greatest(F.col("n") + F.col("m") - both, F.lit(1))
    return sizes.join(stayed, ["user_id", "window"], "left").select("user_id", "window", (1.0 - both / union).alias("churn"))
