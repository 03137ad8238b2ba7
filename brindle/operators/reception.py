"""Reception of posts per opinion cluster, its shrinkage and the bridged score.

Clusters are numbered from 0; their number K is a setting, so arrays of K values per post are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import Settings


def cluster_reception(weighted: DataFrame, clusters: DataFrame) -> DataFrame:
    """(post_id, cluster, n_cp, r_emp): weight and weighted mean value per post and cluster, where the weight is positive."""
    total = F.sum("weight")
    return (
        weighted.join(clusters.select("user_id", "cluster"), "user_id")
        .groupBy("post_id", "cluster")
        .agg(total.alias("n_cp"), F.sum(F.col("weight") * F.col("value")).alias("__s"))
        .filter(F.col("n_cp") > 0)
        .select("post_id", "cluster", "n_cp", (F.col("__s") / F.col("n_cp")).alias("r_emp"))
    )


def scaled_by_source(weighted: DataFrame, source: str, factor: float) -> DataFrame:
    """Weights of reactions whose exposure had the given source, scaled."""
    return weighted.withColumn("weight", F.col("weight") * F.when(F.col("source") == source, F.lit(factor)).otherwise(F.lit(1.0)))


def aggregate(values: Column, how: str, ede_epsilon: float = 4.0) -> Column:
    """One score from an array of per-cluster receptions in [-1, 1]: the least, the geometric mean or the Atkinson equivalent."""
    if how == "min":
        return F.array_min(values)
    p = F.transform(values, lambda r: F.least(F.greatest((r + 1.0) / 2.0, F.lit(1e-6)), F.lit(1.0)))

    def mean(f) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda a, x: a + f(x)) / F.size(p)

    if how == "nash" or (how == "ede" and abs(ede_epsilon - 1.0) < 1e-9):
        return F.exp(mean(F.log)) * 2.0 - 1.0
    if how == "ede":
        k = 1.0 - ede_epsilon
        return F.pow(mean(lambda x: F.pow(x, F.lit(k))), F.lit(1.0 / k)) * 2.0 - 1.0
    raise ValueError(f"unknown aggregator {how!r}")


def score_posts(
    posts: DataFrame,
    reception: DataFrame,
    mu: Column | float,
    s: Settings = Settings(),
    priors: DataFrame | None = None,
    caps: DataFrame | None = None,
) -> DataFrame:
    """(post_id, b_lcb, per_cluster ARRAY) of the given posts.

    reception as of `cluster_reception`; priors: (post_id, prior ARRAY of K) or None for the global mean; caps:
    (post_id, cap), NULL or absent for none. A cluster without evidence stands at its prior (with the subtractive
    bound: at its prior less the whole penalty).
    """
    K = s.clusters
    held = reception.groupBy("post_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("n_cp", "r_emp")))).alias("__rec")
    )
    rows = posts.select("post_id").join(held, "post_id", "left")
    if priors is not None:
        rows = rows.join(priors.select("post_id", F.col("prior").alias("__prior")), "post_id", "left")
    if caps is not None:
        rows = rows.join(caps.select("post_id", F.col("cap").alias("__cap")), "post_id", "left")
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    rows = rows.withColumn("__mu", mu)

    def shrunk(c: Column) -> Column:
        own = F.coalesce(F.get("__prior", c), F.col("__mu")) if priors is not None else F.col("__mu")
        cell = F.try_element_at("__rec", c)
        n, r = F.coalesce(cell["n_cp"], F.lit(0.0)), F.coalesce(cell["r_emp"], own)
        if s.subtractive:
            out = r - F.lit(s.lcb_beta * s.lcb_sigma) / F.sqrt(n + 1.0)
        else:
            out = own + n / (n + F.lit(float(s.n0))) * (r - own)
        return F.least(out, F.col("__cap")) if caps is not None else out

    rows = rows.withColumn("per_cluster", F.transform(F.sequence(F.lit(0), F.lit(K - 1)), shrunk))
    return rows.select("post_id", aggregate(F.col("per_cluster"), s.aggregator, s.ede_epsilon).alias("b_lcb"), "per_cluster")


# ---------------------------------------------------------------------------------------------
# history of authors, priors


def by_author(reception: DataFrame, posts: DataFrame) -> DataFrame:
    """(author_id, cluster, total, wt): this window's reception summed by author."""
    return (
        reception.join(posts.select("post_id", "author_id"), "post_id")
        .filter(F.col("author_id").isNotNull())
        .groupBy("author_id", "cluster")
        .agg(F.sum(F.col("n_cp") * F.col("r_emp")).alias("total"), F.sum("n_cp").alias("wt"))
    )


def decayed_merge(state: DataFrame | None, window: DataFrame, keys: list[str], values: list[str], decay: float) -> DataFrame:
    """State of all keys after a window: old values decayed, the window's added; keys without news decay too."""
    if state is None:
        return window.select(*keys, *values)
    a = state.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    both = a.join(window.select(*keys, *values), keys, "full_outer")
    return both.select(
        *keys, *[(F.coalesce(f"__{v}", F.lit(0.0)) * F.lit(decay) + F.coalesce(v, F.lit(0.0))).alias(v) for v in values]
    )


def cluster_priors(reception: DataFrame, mu: Column, n0: float, K: int) -> DataFrame:
    """(cluster, cp) of every cluster: the window's mean reception, shrunk to the global mean."""
    sums = reception.groupBy("cluster").agg(F.sum(F.col("n_cp") * F.col("r_emp")).alias("s"), F.sum("n_cp").alias("w"))
    every = reception.sparkSession.range(K).select(F.col("id").cast("int").alias("cluster"))
    w = F.coalesce("w", F.lit(0.0))
    mean = F.when(w > 0, F.col("s") / F.col("w")).otherwise(F.col("__mu"))
    rows = every.join(sums, "cluster", "left").withColumn("__mu", mu)
    return rows.select("cluster", (F.col("__mu") + w / (w + F.lit(float(n0))) * (mean - F.col("__mu"))).alias("cp"))


def hierarchical_priors(
    reception: DataFrame,
    posts: DataFrame,
    mu: Column,
    s: Settings = Settings(),
    history: DataFrame | None = None,
    vouch_history: DataFrame | None = None,
    quality: bool | None = None,
) -> DataFrame:
    """(post_id, prior ARRAY): per cluster, the author's history shrunk to the cluster's prior.

    With quality the approval history can only lower the prior below the cluster's; vouches license a lift. Authors
    without history stand at the cluster's prior.
    """
    quality = s.prior_quality if quality is None else quality
    cp = cluster_priors(reception, mu, s.n0, s.clusters)
    row = cp.agg(F.sort_array(F.collect_list(F.struct("cluster", "cp"))).alias("a")).select(F.transform("a", lambda x: x["cp"]).alias("cp"))
    base = row.scalar()
    if history is None:
        return posts.select("post_id", base.alias("prior"))
    shape = F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("total", "wt"))))
    authors = history.groupBy("author_id").agg(shape.alias("__h"))
    if vouch_history is not None:
        authors = authors.join(vouch_history.groupBy("author_id").agg(shape.alias("__v")), "author_id", "left")
    rows = posts.select("post_id", "author_id").join(authors, "author_id", "left").withColumn("__cp", base)

    def prior(c: Column) -> Column:
        own = F.get("__cp", c)
        h = F.try_element_at("__h", c)
        shrunk = own + h["wt"] / (h["wt"] + F.lit(s.n0_author)) * (h["total"] / h["wt"] - own)
        if quality:
            credit = F.lit(0.0)
            if vouch_history is not None:
                v = F.try_element_at("__v", c)
                credit = F.when(v["wt"] > 0, F.greatest(v["total"] / v["wt"], F.lit(0.0)) * v["wt"] / (v["wt"] + F.lit(s.n0_author))).otherwise(0.0)
            shrunk = F.least(shrunk, own + credit)
        return F.when(h["wt"] > 0, shrunk).otherwise(own)

    return rows.select("post_id", F.transform(F.sequence(F.lit(0), F.lit(s.clusters - 1)), prior).alias("prior"))


# ---------------------------------------------------------------------------------------------
# calibration against exploration, caps


def reception_by_source(weighted: DataFrame, clusters: DataFrame) -> DataFrame:
    """(post_id, cluster, org_w, org_s, exp_w, exp_s): weight and weighted value, organic and under exploration."""
    explored = F.coalesce(F.col("source") == "exploration", F.lit(False))
    w, wv = F.col("weight"), F.col("weight") * F.col("value")

    def part(cond: Column, x: Column) -> Column:
        return F.sum(F.when(cond, x).otherwise(0.0))

    return (
        weighted.join(clusters.select("user_id", "cluster"), "user_id")
        .groupBy("post_id", "cluster")
        .agg(part(~explored, w).alias("org_w"), part(~explored, wv).alias("org_s"), part(explored, w).alias("exp_w"), part(explored, wv).alias("exp_s"))
    )


def calibrated(reception: DataFrame, split: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(post_id, cluster, n_cp, r_emp, r_org, r_exp, pair_w): explored reception where there is some, else the model's.

    model: (cluster, sw, swx, swy, swxx, swxy), weighted moments of earlier pairs; a cluster without enough
    evidence (sw < 8) or spread keeps its organic reception.
    """
    s = split.select(
        "post_id",
        "cluster",
        F.when(F.col("org_w") > 0, F.col("org_s") / F.col("org_w")).alias("r_org"),
        F.when(F.col("exp_w") > 0, F.col("exp_s") / F.col("exp_w")).alias("r_exp"),
        "exp_w",
    )
    rows = reception.join(s, ["post_id", "cluster"], "left")
    predicted = F.coalesce("r_org", "r_emp")
    if model is not None:
        rows = rows.join(model, "cluster", "left")
        det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
        enough = (F.col("sw") >= 8) & (F.abs(det) >= 1e-9)
        slope = F.when(enough, (F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / det)
        level = F.when(enough, (F.col("swy") - slope * F.col("swx")) / F.col("sw"))
        predicted = F.coalesce(level + slope * F.col("r_org"), predicted)
    pair = F.col("r_org").isNotNull() & F.col("r_exp").isNotNull()
    return rows.select(
        "post_id",
        "cluster",
        "n_cp",
        F.coalesce("r_exp", predicted).alias("r_emp"),
        "r_org",
        "r_exp",
        F.when(pair, F.col("exp_w")).alias("pair_w"),
    )


def calibration_moments(state: DataFrame | None, pairs: DataFrame, decay: float = 0.8) -> DataFrame:
    w, x, y = F.col("pair_w"), F.col("r_org"), F.col("r_exp")
    window = pairs.filter(w.isNotNull()).groupBy("cluster").agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * y).alias("swy"), F.sum(w * x * x).alias("swxx"), F.sum(w * x * y).alias("swxy")
    )
    return decayed_merge(state, window, ["cluster"], ["sw", "swx", "swy", "swxx", "swxy"], decay)


def exploration_anchor(reactions: DataFrame, exposures: DataFrame, posts: DataFrame, state: DataFrame | None = None, decay: float = 0.6) -> DataFrame:
    """(author_id, total, n): sums over reactions on pairs that some exploration exposure showed."""
    explored = exposures.filter(F.col("source") == "exploration").select("user_id", "post_id").distinct()
    window = (
        reactions.drop("author_id")
        .join(explored, ["user_id", "post_id"], "left_semi")
        .join(posts.select("post_id", "author_id"), "post_id")
        .groupBy("author_id")
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    return decayed_merge(state, window, ["author_id"], ["total", "n"], decay)


def anchor_caps(posts: DataFrame, anchor: DataFrame, z: float = 1.0, sigma: float = 1.0) -> DataFrame:
    """(post_id, cap): upper bound of the author's explored reception; NULL without evidence."""
    n = F.col("n") + F.lit(3.0)
    cap = F.when(F.col("n") >= 1, F.col("total") / n + F.lit(z * sigma) / F.sqrt(n))
    return posts.select("post_id", "author_id").join(anchor, "author_id", "left").select("post_id", cap.alias("cap"))


def depth_scores(vouch_reception: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(post_id, depth) in [0, 1] of the vouched posts: their vouch reception shrunk to 0, aggregated."""
    vouched = vouch_reception.select("post_id").distinct()
    plain = Settings(**{**s.__dict__, "subtractive": False})
    scored = score_posts(vouched, vouch_reception, 0.0, plain)
    q = (F.col("b_lcb") + 1.0) / 2.0
    return scored.select("post_id", F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)).alias("depth"))


# ---------------------------------------------------------------------------------------------
# variants of penalty and aggregation


def group_stats(votes: DataFrame, item: str, group: str, value: str) -> DataFrame:
    """(item, group, mean, n, var, grand): per group, with the item's mean over all its votes."""
    sums = votes.groupBy(F.col(item).alias("item"), F.col(group).alias("group")).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.var_pop(value).alias("var")
    )
    grand = sums.groupBy("item").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("grand"))
    return sums.join(grand, "item")


PENALTIES = ("none", "wald_count", "wald_var", "wilson", "james_stein")
AGGREGATORS = ("min", "mean", "nash", "cvar", "ede1", "ede4")


def penalised(kind: str, z: float = 1.0, n0: float = 8.0) -> Column:
    """A group's mean, lowered by its uncertainty; columns mean, n, var, grand."""
    mean, n = F.col("mean"), F.col("n").cast("double")
    if kind == "none":
        return mean
    if kind == "wald_count":
        return mean - F.lit(z) / F.sqrt(n + 1.0)
    if kind == "wald_var":
        return mean - F.lit(z) * F.sqrt(F.greatest(F.col("var"), F.lit(0.0)) / F.greatest(n, F.lit(1.0)))
    if kind == "wilson":
        p, zz = (mean + 1.0) / 2.0, z * z
        centre = p + F.lit(zz) / (2.0 * n)
        spread = F.lit(z) * F.sqrt(F.greatest(p * (1.0 - p) / n + F.lit(zz) / (4.0 * n * n), F.lit(0.0)))
        return (centre - spread) / (1.0 + F.lit(zz) / n) * 2.0 - 1.0
    if kind == "james_stein":
        return F.col("grand") + n / (n + F.lit(n0)) * (mean - F.col("grand"))
    raise ValueError(f"unknown penalty {kind!r}")


def combined(kind: str, x: Column, alpha: float = 0.5) -> Column:
    """Aggregate of a group-wise column into one score per item."""
    p = F.least(F.greatest((x + 1.0) / 2.0, F.lit(1e-6)), F.lit(1.0))
    if kind == "min":
        return F.min(x)
    if kind == "mean":
        return F.avg(x)
    if kind in ("nash", "ede1"):
        return F.exp(F.avg(F.log(p))) * 2.0 - 1.0
    if kind == "ede4":
        return F.pow(F.avg(F.pow(p, F.lit(-3.0))), F.lit(-1.0 / 3.0)) * 2.0 - 1.0
    if kind == "cvar":
        ordered = F.array_sort(F.collect_list(x))  # groups of an item: bounded by the number of groups
        k = F.greatest(F.ceil(F.size(ordered) * F.lit(alpha)).cast("int"), F.lit(1))
        return F.aggregate(F.slice(ordered, F.lit(1), k), F.lit(0.0), lambda a, b: a + b) / k
    raise ValueError(f"unknown aggregator {kind!r}")


def keystone_grid(stats: DataFrame, z: float = 1.0) -> DataFrame:
    """(item, penalty, aggregator, score) for every pair of penalty and aggregator, from one pass over the statistics."""
    rows = stats.filter(F.col("n") > 0).select("item", *[penalised(k, z).alias(k) for k in PENALTIES])
    wide = rows.groupBy("item").agg(*[combined(a, F.col(k)).alias(f"{k}|{a}") for k in PENALTIES for a in AGGREGATORS])
    cells = [F.struct(F.lit(k).alias("penalty"), F.lit(a).alias("aggregator"), F.col(f"{k}|{a}").alias("score")) for k in PENALTIES for a in AGGREGATORS]
    return wide.select("item", F.explode(F.array(*cells)).alias("c")).select("item", "c.aggregator", "c.score", "c.penalty")
