"""Queries of factorization, geometry, serving, streaming forms, metrics and loaders over the registered tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.config import Knobs, Settings
from brindle.functions import instants
from brindle.operators import core, factorization, feed, geometry, metrics, simulate
from brindle.plans.base import PRE, r6
from brindle.plans.rater_queries import Raters
from brindle.plans.window import Engine
from brindle.session import cut

S = Settings()
ONE = replace(S, d=1)


def _start(b: Raters) -> tuple[DataFrame, DataFrame]:
    """Closed-form starting vectors of one dimension for users and posts."""
    def x(key: str):
        return F.array(((F.ascii(F.substring(key, -1, 1)) * 7919) % 101 - 50).cast("double") / 500.0)

    return b.reactions.select("user_id").distinct().select("user_id", x("user_id").alias("x")), b.reacted_posts.select("post_id").select("post_id", x("post_id").alias("y"))


def _fit(b: Raters, **kw) -> factorization.Model:
    users, posts = _start(b)
    return factorization.fit(b.reactions.withColumn("weight", F.lit(1.0)), ONE, users=users, posts=posts, sweeps=2, tolerance=-1.0, **kw)


def mf_als_d1(spark: SparkSession, d: str) -> DataFrame:
    """Two sweeps in one dimension from closed-form vectors: biases and loadings of posts."""
    m = _fit(Raters(spark, d))
    return m.posts.select("post_id", r6("b_p").alias("b_p"), r6(F.get("y", F.lit(0))).alias("y"))


def mf_bias_only(spark: SparkSession, d: str) -> DataFrame:
    """Two sweeps of the biases alone, with vectors of 0."""
    b = Raters(spark, d)
    m = factorization.fit(b.reactions.withColumn("weight", F.lit(1.0)), ONE, sweeps=2, tolerance=-1.0, bias_only=True)
    return m.users.select("user_id", r6("b_u").alias("b_u"))


def mf_predict(spark: SparkSession, d: str) -> DataFrame:
    """Predicted value of every exposed pair after two sweeps in one dimension."""
    b = Raters(spark, d)
    rows = b.exposures.select("user_id", "post_id").join(b.posts.select("post_id", "author_id"), "post_id")
    return _fit(b).predict(rows).select("user_id", "post_id", r6("predicted").alias("predicted"))


def mf_als_d(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    m = factorization.fit(b.weighted, S)
    return m.posts.select("post_id", "b_p", "y")


def mf_als_d2(spark: SparkSession, d: str) -> DataFrame:
    """Two sweeps in two dimensions from closed-form vectors."""
    b = Raters(spark, d)

    def x(key: str):
        return F.array(*[((F.ascii(F.substring(key, -k, 1)) * 7919) % 101 - 50).cast("double") / 500.0 for k in (1, 2)])

    users, posts = b.reactions.select("user_id").distinct().select("user_id", x("user_id").alias("x")), b.reacted_posts.select("post_id").select("post_id", x("post_id").alias("y"))
    m = factorization.fit(b.reactions.withColumn("weight", F.lit(1.0)), replace(S, d=2), users=users, posts=posts, sweeps=2, tolerance=-1.0)
    return m.posts.select("post_id", r6("b_p").alias("b_p"), *[F.round(F.get("y", F.lit(k)), 5) .alias(f"y{k}") for k in (0, 1)])


def _vectors(b: Raters) -> DataFrame:
    """Two-dimensional closed-form vectors of posts."""
    one = F.ascii(F.substring("post_id", -1, 1)) % 7 - 3
    two = F.ascii(F.substring("post_id", -2, 1)) % 5 - 2
    return b.reacted_posts.select("post_id", F.array(one.cast("double"), two.cast("double")).alias("y"))


#: Fixed whitening of the registered query on divisiveness.
_D = geometry.Divisiveness(np.array([0.5, -0.25]), np.array([[0.5, 0.1], [0.1, 0.75]]), np.eye(2))


def divisiveness_identity(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(Raters(spark, d)).select("post_id", r6(_D.column(F.col("y"), 0.5)).alias("divisiveness"))


def whiten_moments(spark: SparkSession, d: str) -> DataFrame:
    """Covariance of the post vectors after whitening: the unit matrix."""
    rows = cut(_vectors(Raters(spark, d)))
    m = geometry.fit_divisiveness(rows, 2)
    w = rows.select(m.whitened(F.col("y")).alias("w"))
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    return w.agg(F.round(F.covar_samp(a, a), 4).alias("aa"), (F.round(F.covar_samp(a, b), 4) + 0.0).alias("ab"), F.round(F.covar_samp(b, b), 4).alias("bb"))


def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    users = b.clusters.select("user_id", F.array("x").alias("x"), (F.col("x") / 10.0).alias("b_u"))
    out = geometry.cluster_stats(users, b.clusters, 1)
    return out.select("cluster", "n", r6(F.get("centroid", F.lit(0))).alias("centroid"), r6("mean_bias").alias("mean_bias"))


def spectral_clusters(spark: SparkSession, d: str) -> DataFrame:
    return geometry.spectral_partition(Raters(spark, d).reactions, 2, rounds=30)


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("user_id"), F.col("embedding").cast("array<double>").alias("x"))
    return geometry.kmeans_partition(rows, 10)


# ---------------------------------------------------------------------------------------------
# serving


def _candidates(b: Raters) -> DataFrame:
    """Exposed pairs of raters, with closed-form vectors of viewer and post."""
    y = (F.ascii(F.substring("post_id", -1, 1)) % 7 - 3).cast("double")
    rows = b.exposures.select("user_id", "post_id", F.col("ordinal").alias("pos")).join(b.clusters, "user_id").join(b.posts, "post_id")
    return rows.join(b.scores.select("post_id", "b_lcb", "per_cluster"), "post_id", "left").withColumn("y", F.array(y)).withColumn("xy", F.col("x") * y / 9.0).withColumn("D", y * y / 9.0)


def value_by_user(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(Raters(spark, d))
    v = feed.canonical_value(F.coalesce("b_lcb", F.lit(0.0)), F.col("xy"), F.col("y"), F.col("D"), F.lit(0.7), F.lit(1.0))
    return rows.select("user_id", "post_id", r6(v).alias("value"))


def depth_gate(spark: SparkSession, d: str) -> DataFrame:
    """Bridge factor under a full depth gate and reward; depth from the length of the post."""
    depth = F.least(F.coalesce(F.col("features")["chars"], F.lit(0.0)) / 300.0, F.lit(1.0))
    rows = _candidates(Raters(spark, d)).withColumns({"depth": depth, "M": F.lit(0.7), "rho": F.lit(1.0)})
    return rows.select("user_id", "post_id", r6(feed.bridge_factor(1.0, 0.2)).alias("value"))


def blended_value(spark: SparkSession, d: str) -> DataFrame:
    """Half bridge, a quarter recency, a quarter an unknown factor."""
    knobs = Knobs(theta={"bridge": 2.0, "recency": 1.0, "novelty": 1.0})
    rows = _candidates(Raters(spark, d)).withColumns(
        {"depth": F.lit(1.0), "M": F.lit(0.7), "rho": F.lit(1.0), "theta": core.literal_map(knobs.normalised_theta()), "extras": F.create_map(F.lit("recency"), F.col("pos") % 10 / 10.0)}
    )
    return rows.select("user_id", "post_id", r6(feed.blended_value(F.col("theta"))).alias("value"))


def rank_chronological(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, whatever the unit of the posts' stamps; unknown ones last."""
    rows = _candidates(Raters(spark, d)).withColumn("created_at", instants.double_us(F.col("created_at")))
    return feed.chronological(rows, 5)


def rank_engagement(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(Raters(spark, d))
    return feed.by_score(rows, F.round("xy", 9), 5)


def _ready(b: Raters) -> DataFrame:
    seen = F.col("b_lcb").isNotNull()
    return _candidates(b).select(
        "user_id", "pos", "post_id", "author_id", F.coalesce("b_lcb", F.lit(0.0)).alias("base"), F.when(seen, 0.0).otherwise(0.3).alias("exploration"),
        F.lit(1.0).alias("posdisc"), F.when(seen, F.transform("per_cluster", lambda r: F.greatest(r, F.lit(0.0)))).alias("coverage"), F.lit(1.0).alias("cost"),
        (~seen).alias("is_exploration"), F.lit(2.0).alias("budget"),
    )


def feed_greedy(spark: SparkSession, d: str) -> DataFrame:
    return feed.greedy_feeds(_ready(Raters(spark, d)), 6, 0.2)


def feed_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Feeds served with an exploration slice, and their logged propensities."""
    b = Raters(spark, d)
    ranked = feed.greedy_feeds(_ready(b), 10, 0.1)
    return feed.serve(ranked, _candidates(b), 10, 0.2)


def fitted_window(spark: SparkSession, d: str) -> DataFrame:
    """One whole learning window: bridged scores of all posts from spectral clusters, factorization and influence."""
    b = Raters(spark, d)
    engine = Engine(S)
    return engine.fit_window(b.all_reactions, b.posts, b.table("exposures")).scores.select("post_id", "author_id", "b_lcb")


# ---------------------------------------------------------------------------------------------
# windows of the service, in batch


def derived_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Served pairs without a positive reaction."""
    b = Raters(spark, d)
    served = b.table("exposures").select("user_id", "post_id").distinct().join(b.posts.select("post_id"), "post_id", "left_semi")
    liked = b.all_reactions.filter("value > 0 and kind is distinct from 'vouch'").select("user_id", "post_id")
    return served.join(liked, ["user_id", "post_id"], "left_anti").select("user_id", "post_id", F.lit(-0.1).alias("value"))


def served_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Posts of the last six hours before the newest one, whatever the unit of their stamps, newest first, at most 4000."""
    rows = Raters(spark, d).posts.withColumn("us", instants.double_us(F.col("created_at"))).filter("us is not null")
    newest = rows.agg(F.max("us").alias("t")).scalar()
    kept = rows.filter(F.col("us") >= newest - F.lit(6 * 3_600_000_000).cast("long")).orderBy(F.desc("us"), "post_id").limit(4000)
    return kept.select("post_id", "author_id", (F.col("us") / 1e6).alias("created_at"))


def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Reactions per quarter of an hour of their own time."""
    rows = Raters(spark, d).reactions.filter("ts > 0")
    w = F.floor(F.col("ts") / 900.0).cast("long") * F.lit(900).cast("long")
    return rows.groupBy(w.alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), r6(F.sum("value")).alias("total"))


def window_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's reactions: a gap of more than half an hour begins a new one."""
    rows = Raters(spark, d).reactions.filter("ts > 0")
    w = Window.partitionBy("user_id").orderBy("ts", "ordinal")
    begins = F.when(F.col("ts") - F.lag("ts").over(w) <= 1800.0, 0).otherwise(1)
    rows = rows.withColumn("__b", begins).withColumn("session", F.sum("__b").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), r6(F.max("ts") - F.min("ts")).alias("seconds"))


def feed_churn(spark: SparkSession, d: str) -> DataFrame:
    """Change of the exposed posts of a user from day to day."""
    rows = Raters(spark, d).table("exposures").filter("timestamp > 0")
    return metrics.churn(rows.select("user_id", "post_id", F.floor(F.col("timestamp") / 86400).cast("int").alias("window"))).select("user_id", "window", r6("churn").alias("churn"))


# ---------------------------------------------------------------------------------------------
# metrics and slices


def _judged(b: Raters) -> DataFrame:
    return b.reactions.join(b.scores.select("post_id", F.round("b_lcb", 9).alias("score")), "post_id").withColumn("label", F.when(F.col("value") > 0, 1).otherwise(0))


def auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_judged(Raters(spark, d)), "score", "label").select(r6("auc").alias("auc"))


def balanced_auc(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    rows = b.reactions.select("ordinal", "post_id", F.when(F.col("value") > 0, 1).otherwise(0).alias("label"))
    return metrics.balanced_auc(rows.join(b.folded_scores.select("post_id", F.round("b_lcb", 9).alias("score")), "post_id"), "score", "label", "ordinal")


def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(Raters(spark, d)).withColumn("rel", F.greatest("value", F.lit(0.0)))
    return metrics.ndcg_at_k(rows, "user_id", "score", "rel", "ordinal", 5).select("user_id", r6("ndcg").alias("ndcg"))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Bridged score of posts against their mean value."""
    b = Raters(spark, d)
    rows = b.reactions.groupBy("post_id").agg(F.round(F.avg("value"), 9).alias("m")).join(b.scores.select("post_id", F.round("b_lcb", 9).alias("score")), "post_id")
    return metrics.spearman(rows, "m", "score").select(r6("spearman").alias("spearman"))


def rank_average(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the known stamps of posts, whatever their unit."""
    return metrics.average_ranks(Raters(spark, d).posts.withColumn("us", instants.double_us(F.col("created_at"))), "us", "rank").select("post_id", "rank")


def ari(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the closed-form clusters with the sign of the closed-form coordinate."""
    rows = Raters(spark, d).clusters.withColumn("side", F.when(F.col("x") > 0, 1).otherwise(0))
    return metrics.adjusted_rand_index(rows, "cluster", "side").select(r6("ari").alias("ari"))


def embedding_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Distances of embeddings against those of their first eight dimensions."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("user_id"), F.col("embedding").cast("array<double>").alias("true"))
    return metrics.embedding_recovery(e.withColumn("est", F.slice("true", 1, 8))).select(F.round("recovery", 5).alias("recovery"))


def kcore(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of the core in which every note and every rater keeps at least 8."""
    rows = Raters(spark, d).table("ratings").select("noteId", F.lower(F.trim("raterId")).alias("rater")).distinct()
    return metrics.kcore(rows, "noteId", "rater", 8, 8)


def dense_slice(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dense_slice(Raters(spark, d).reactions, 100, 50).select("ordinal", "user_id", "post_id")


def simulate_population(spark: SparkSession, d: str) -> DataFrame:
    return simulate.population(spark, 40)


def simulate_reactions(spark: SparkSession, d: str) -> DataFrame:
    posts = simulate.posts_of(simulate.authors(spark), 0)
    return simulate.react(simulate.population(spark, 40).crossJoin(posts))


def welfare(spark: SparkSession, d: str) -> DataFrame:
    posts = simulate.posts_of(simulate.authors(spark), 0)
    return simulate.welfare(simulate.population(spark, 40).crossJoin(posts))


def mnar_log(spark: SparkSession, d: str) -> DataFrame:
    return simulate.biased_log(simulate.mnar_world(spark, 60, 40), 0.15)


def mnar_experiment(spark: SparkSession, d: str) -> DataFrame:
    """A factorization of a biased log, without and with inverse propensities."""
    return simulate.mnar_experiment(spark, epsilon=0.15)


def induced_mnar(spark: SparkSession, d: str) -> DataFrame:
    return simulate.induce_mnar(Raters(spark, d).reactions).select("ordinal", "split", r6("propensity").alias("propensity"))


QUERIES = {
    f.__name__: f
    for f in (
        mf_als_d1, mf_als_d2, mf_bias_only, mf_predict, mf_als_d, divisiveness_identity, whiten_moments, cluster_centroids, spectral_clusters, kmeans_clusters,
        value_by_user, depth_gate, blended_value, rank_chronological, rank_engagement, feed_greedy, feed_interleaved, fitted_window, derived_negatives,
        served_candidates, window_tumbling, window_session, feed_churn, auc, balanced_auc, ndcg_at_5, spearman, rank_average, ari, embedding_recovery,
        kcore, dense_slice, simulate_population, simulate_reactions, welfare, mnar_log, mnar_experiment, induced_mnar,
    )
}


def _als(sweeps: int, vectors: bool) -> str:
    """Unrolled sweeps over one row per observation; each step is a window sum."""
    x0 = "CAST((ascii(right({k}, 1)) * 7919) % 101 - 50 AS DOUBLE) / 500.0" if vectors else "0.0"
    out = PRE + f", o0 AS MATERIALIZED (SELECT user_id, post_id, author_id, val AS r, 0.0 AS bu, 0.0 AS ba, 0.0 AS bp, {x0.format(k='user_id')} AS xx, {x0.format(k='post_id')} AS yy, 0.0 AS mu FROM r)"
    n = 0

    def step(change: str) -> str:
        nonlocal n
        n += 1
        return f", o{n} AS MATERIALIZED (SELECT * REPLACE ({change}) FROM o{n - 1})"

    for _ in range(sweeps):
        out += step("avg(r - bu - ba - bp - xx * yy) OVER () AS mu")
        out += step("sum(r - mu - ba - bp - xx * yy) OVER (PARTITION BY user_id) / (count(*) OVER (PARTITION BY user_id) + 0.1) AS bu")
        out += step("sum(r - mu - bu - bp - xx * yy) OVER (PARTITION BY author_id) / (count(*) OVER (PARTITION BY author_id) + 0.05) AS ba")
        out += step("sum(r - mu - bu - ba - xx * yy) OVER (PARTITION BY post_id) / (count(*) OVER (PARTITION BY post_id) + 0.1) AS bp")
        if vectors:
            out += step("sum(yy * (r - mu - bu - ba - bp)) OVER (PARTITION BY user_id) / (sum(yy * yy) OVER (PARTITION BY user_id) + 0.05) AS xx")
            out += step("sum(xx * (r - mu - bu - ba - bp)) OVER (PARTITION BY post_id) / (sum(xx * xx) OVER (PARTITION BY post_id) + 0.05) AS yy")
    return out + f", ob AS (SELECT * FROM o{n})"


def _als2(sweeps: int) -> str:
    """The same in two dimensions, with the normal equations solved in closed form."""
    x0 = "CAST((ascii(left(right({k}, {i}), 1)) * 7919) % 101 - 50 AS DOUBLE) / 500.0 AS {n}"
    start = ", ".join(x0.format(k=k, i=i, n=f"{n}{i}") for k, n in (("user_id", "x"), ("post_id", "y")) for i in (1, 2))
    out, n = PRE + f", o0 AS MATERIALIZED (SELECT user_id, post_id, author_id, val AS r, 0.0 AS bu, 0.0 AS ba, 0.0 AS bp, {start}, 0.0 AS mu FROM r)", 0
    xy = "(x1 * y1 + x2 * y2)"

    def solved(own: str, other: str, key: str) -> str:
        def total(e: str) -> str:
            return f"sum({e}) OVER (PARTITION BY {key})"

        p, q, c = f"({total(f'{other}1 * {other}1')} + 0.05)", f"({total(f'{other}2 * {other}2')} + 0.05)", total(f"{other}1 * {other}2")
        t1, t2 = (total(f"{other}{i} * (r - mu - bu - ba - bp)") for i in (1, 2))
        return f"({t1} * {q} - {t2} * {c}) / ({p} * {q} - {c} * {c}) AS {own}1, ({t2} * {p} - {t1} * {c}) / ({p} * {q} - {c} * {c}) AS {own}2"

    steps = [
        f"avg(r - bu - ba - bp - {xy}) OVER () AS mu",
        f"sum(r - mu - ba - bp - {xy}) OVER (PARTITION BY user_id) / (count(*) OVER (PARTITION BY user_id) + 0.1) AS bu",
        f"sum(r - mu - bu - bp - {xy}) OVER (PARTITION BY author_id) / (count(*) OVER (PARTITION BY author_id) + 0.05) AS ba",
        f"sum(r - mu - bu - ba - {xy}) OVER (PARTITION BY post_id) / (count(*) OVER (PARTITION BY post_id) + 0.1) AS bp",
        solved("x", "y", "user_id"),
        solved("y", "x", "post_id"),
    ]
    for change in steps * sweeps:
        n += 1
        out += f", o{n} AS MATERIALIZED (SELECT * REPLACE ({change}) FROM o{n - 1})"
    return out + f" SELECT DISTINCT post_id, round(bp, 6) + 0.0 AS b_p, round(y1, 5) AS y0, round(y2, 5) AS y1 FROM o{n}"


def _kcore(least: int, rounds: int = 60) -> str:
    """Unrolled rounds, more than a core of this size takes to settle."""
    out = "WITH e0 AS MATERIALIZED (SELECT DISTINCT noteId, lower(trim(raterId)) AS rater FROM ratings)"
    for i in range(1, rounds + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT * FROM e{i - 1} WHERE noteId IN (SELECT noteId FROM e{i - 1} GROUP BY 1 HAVING count(*) >= {least})),
          e{i} AS MATERIALIZED (SELECT * FROM a{i} WHERE rater IN (SELECT rater FROM a{i} GROUP BY 1 HAVING count(*) >= {least}))"""
    return out + f" SELECT noteId, rater FROM e{rounds}"


#: s: posts with a known stamp, in microseconds whatever its unit.
_STAMPED = """u AS (SELECT *, CASE WHEN created_at < 1e11 THEN 1000000.0 WHEN created_at < 1e14 THEN 1000.0 WHEN created_at < 1e17 THEN 1.0 ELSE 0.001 END AS f
          FROM posts WHERE created_at > 0 AND created_at < 9e18 AND NOT isnan(created_at)),
        s AS (SELECT *, CASE WHEN f < 1 THEN CAST(floor(created_at / 1000.0 + 0.5) AS BIGINT)
          ELSE CAST(floor(created_at) AS BIGINT) * CAST(f AS BIGINT) + CAST(floor((created_at - floor(created_at)) * f + 0.5) AS BIGINT) END AS us FROM u)"""
_CAND = PRE + """, ca AS (SELECT e.user_id, e.post_id, e.ordinal AS pos, p.author_id, p.created_at, p.features, k.x, CAST(ascii(right(e.post_id, 1)) % 7 - 3 AS DOUBLE) AS y, sc.b_lcb
     FROM e JOIN k USING (user_id) JOIN posts p ON p.post_id = e.post_id LEFT JOIN sc ON sc.post_id = e.post_id)
"""
_JUDGED = PRE + ", ju AS (SELECT r.*, round(b_lcb, 9) AS score FROM r JOIN sc USING (post_id))"

_MD5 = "('0x' || substr(md5(concat_ws('|', user_id, post_id, '{}')), 1, 13))::BIGINT / 4503599627370496.0"
SQL = {
    "mf_als_d2": _als2(2),
    "kcore": _kcore(8),
    "balanced_auc": _JUDGED + """, sz AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ju GROUP BY val > 0)),
        dr AS (SELECT score, val > 0 AS pos, draw FROM ju, range(25) d(draw)
               QUALIFY row_number() OVER (PARTITION BY draw, val > 0 ORDER BY md5(concat_ws('|', ordinal, draw, 0)), ordinal) <= (SELECT n FROM sz)),
        rk AS (SELECT draw, pos, rank() OVER (PARTITION BY draw ORDER BY score) + (count(*) OVER (PARTITION BY draw, score) - 1) / 2.0 AS rk FROM dr),
        au AS (SELECT (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS a FROM rk GROUP BY draw)
        SELECT round(avg(a), 9) AS balanced_auc FROM au""",
    "induced_mnar": PRE + f""", dw AS (SELECT ordinal, 0.1 + 0.9 / (1.0 + exp(-2.0 * val)) AS pi, {_MD5.format(31)} AS a, {_MD5.format(32)} AS b FROM r),
        sp AS (SELECT ordinal, CASE WHEN a < 0.2 THEN 'test' WHEN b < 0.1 THEN 'anchor' WHEN b < pi THEN 'train' END AS split, round(pi, 6) + 0.0 AS propensity FROM dw)
        SELECT * FROM sp WHERE split IS NOT NULL""",
    "mf_als_d1": _als(2, True) + " SELECT DISTINCT post_id, round(bp, 6) + 0.0 AS b_p, round(yy, 6) + 0.0 AS y FROM ob",
    "mf_bias_only": _als(2, False) + " SELECT DISTINCT user_id, round(bu, 6) + 0.0 AS b_u FROM ob",
    "mf_predict": _als(2, True) + """, pu AS (SELECT user_id, any_value(bu) AS bu, any_value(xx) AS xx FROM ob GROUP BY 1), pp AS (SELECT post_id, any_value(bp) AS bp, any_value(yy) AS yy FROM ob GROUP BY 1),
        pa AS (SELECT author_id, any_value(ba) AS ba FROM ob GROUP BY 1)
        SELECT e.user_id, e.post_id, round((SELECT any_value(mu) FROM ob) + coalesce(bu, 0.0) + coalesce(ba, 0.0) + coalesce(bp, 0.0) + coalesce(xx * yy, 0.0), 6) + 0.0 AS predicted
        FROM e JOIN posts p ON p.post_id = e.post_id LEFT JOIN pu ON pu.user_id = e.user_id LEFT JOIN pp ON pp.post_id = e.post_id LEFT JOIN pa ON pa.author_id = p.author_id""",
    "divisiveness_identity": PRE + """, q AS (SELECT post_id, ascii(right(post_id, 1)) % 7 - 3 - 0.5 AS a, ascii(left(right(post_id, 2), 1)) % 5 - 2 + 0.25 AS b FROM rp)
        SELECT post_id, round(CAST(0.5 AS DOUBLE) * (pow(0.5 * a + 0.1 * b, 2) + pow(0.1 * a + 0.75 * b, 2)), 6) + 0.0 AS divisiveness FROM q""",
    "whiten_moments": "SELECT CAST(1.0 AS DOUBLE) AS aa, CAST(0.0 AS DOUBLE) AS ab, CAST(1.0 AS DOUBLE) AS bb",
    "cluster_centroids": PRE + " SELECT cluster, count(*) AS n, round(avg(x), 6) + 0.0 AS centroid, round(avg(x / 10.0), 6) + 0.0 AS mean_bias FROM k GROUP BY 1",
    "value_by_user": _CAND + "SELECT user_id, post_id, round(coalesce(b_lcb, 0.0) + 0.3 * x * y / 9.0 - 0.7 * y * y / 9.0, 6) + 0.0 AS value FROM ca",
    "depth_gate": _CAND + """, de AS (SELECT *, least(coalesce(features['chars'], 0.0) / 300.0, 1.0) AS depth, coalesce(b_lcb, 0.0) AS b FROM ca)
        SELECT user_id, post_id, round(CASE WHEN b > 0 THEN b * (1.0 - 0.75 * (1.0 - depth)) ELSE b END + 0.3 * x * y / 9.0 - 0.7 * y * y / 9.0 + 0.2 * (depth - 0.5), 6) + 0.0 AS value FROM de""",
    "blended_value": _CAND + "SELECT user_id, post_id, round(0.5 * (coalesce(b_lcb, 0.0) + 0.3 * x * y / 9.0 - 0.7 * y * y / 9.0) + 0.25 * CAST(pos % 10 AS DOUBLE) / 10.0, 6) + 0.0 AS value FROM ca",
    "rank_chronological": _CAND + ", " + _STAMPED + """, rk AS (SELECT user_id, ca.post_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC NULLS LAST, ca.post_id) - 1 AS slot FROM ca LEFT JOIN s ON s.post_id = ca.post_id)
        SELECT user_id, slot, post_id FROM rk WHERE slot < 5""",
    "rank_engagement": _CAND + """, rk AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY round(x * y / 9.0, 9) DESC, post_id) - 1 AS slot FROM ca)
        SELECT user_id, slot, post_id FROM rk WHERE slot < 5""",
    "derived_negatives": PRE + """ SELECT DISTINCT user_id, post_id, CAST(-0.1 AS DOUBLE) AS value FROM exposures WHERE post_id IN (SELECT post_id FROM posts)
        AND (user_id, post_id) NOT IN (SELECT (user_id, post_id) FROM r WHERE val > 0)""",
    "served_candidates": "WITH " + _STAMPED + """ SELECT post_id, author_id, us / 1000000.0::DOUBLE AS created_at FROM s WHERE us >= (SELECT max(us) FROM s) - 21600000000 ORDER BY us DESC, post_id LIMIT 4000""",
    "window_tumbling": PRE + " SELECT CAST(floor(ts / 900.0) AS BIGINT) * 900 AS window_start, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(val), 6) + 0.0 AS total FROM r WHERE ts > 0 GROUP BY 1",
    "window_session": PRE + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, ordinal) <= 1800.0 THEN 0 ELSE 1 END AS nw FROM r WHERE ts > 0),
        ss AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, ordinal) AS BIGINT) AS session FROM g)
        SELECT user_id, session, count(*) AS n, round(max(ts) - min(ts), 6) + 0.0 AS seconds FROM ss GROUP BY 1, 2""",
    "feed_churn": """WITH s AS (SELECT user_id, CAST(floor("timestamp" / 86400) AS INT) AS "window", list(DISTINCT post_id) AS s FROM exposures WHERE "timestamp" > 0 GROUP BY 1, 2),
        p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY "window") AS p FROM s)
        SELECT user_id, "window", round(1.0 - len(list_intersect(s, p)) / CAST(len(s) + len(p) - len(list_intersect(s, p)) AS DOUBLE), 6) + 0.0 AS churn FROM p WHERE p IS NOT NULL""",
    "auc": _JUDGED + """, rk AS (SELECT val > 0 AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM ju)
        SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) + 0.0 AS auc FROM rk""",
    "ndcg_at_5": _JUDGED + """, rk AS (SELECT user_id, greatest(val, 0.0) AS rel, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ordinal) AS i,
                row_number() OVER (PARTITION BY user_id ORDER BY greatest(val, 0.0) DESC, ordinal) AS j FROM ju),
        g AS (SELECT user_id, sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) ELSE 0.0 END) AS d, sum(CASE WHEN j <= 5 THEN rel / log2(j + 1) ELSE 0.0 END) AS best FROM rk GROUP BY 1)
        SELECT user_id, round(CASE WHEN best <> 0 THEN d / best ELSE 0.0 END, 6) + 0.0 AS ndcg FROM g""",
    "spearman": PRE + """, s AS (SELECT post_id, round(avg(val), 9) AS m, any_value(round(b_lcb, 9)) AS score FROM r JOIN sc USING (post_id) GROUP BY 1),
        rk AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM s)
        SELECT round(corr(a, b), 6) + 0.0 AS spearman FROM rk""",
    "rank_average": "WITH " + _STAMPED + " SELECT post_id, rank() OVER (ORDER BY us) + (count(*) OVER (PARTITION BY us) - 1) / CAST(2.0 AS DOUBLE) AS rank FROM s",
    "ari": PRE + """, ce AS (SELECT cluster, x > 0 AS side, count(*) AS n FROM k GROUP BY 1, 2),
        su AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ce) AS c, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM ce GROUP BY cluster)) AS pa,
                      (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM ce GROUP BY side)) AS pb, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM ce) AS t)
        SELECT round((c - pa * pb / t) / ((pa + pb) / 2.0 - pa * pb / t), 6) + 0.0 AS ari FROM su""",
    "embedding_recovery": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT round(corr(list_distance(a.v[1:8], b.v[1:8]), list_distance(a.v, b.v)), 5) AS recovery FROM e a JOIN e b ON a.vec_id < b.vec_id""",
    "dense_slice": PRE + """, tu AS (SELECT user_id FROM r GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 100), sm AS (SELECT * FROM r WHERE user_id IN (SELECT user_id FROM tu)),
        ti AS (SELECT post_id FROM sm GROUP BY 1 ORDER BY count(*) DESC, post_id LIMIT 50) SELECT ordinal, user_id, post_id FROM sm WHERE post_id IN (SELECT post_id FROM ti)""",
}
