"""Queries of signals, identities, propensities, reception and bridged scores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.operators import core, propensity, reception
from brindle.plans.base import EPSILON, PRE, Base, nash, r6

S = Settings()


def signal_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = core.signals(Base(spark, d).table("reactions"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def channel_split(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    both = b.reactions.select(F.lit("approval").alias("channel"), "user_id", "value").unionByName(b.vouches.select(F.lit("vouch").alias("channel"), "user_id", "value"))
    return both.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), r6(F.avg("value")).alias("mean_value"))


def exposure_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).exposures.select("user_id", "post_id", "ordinal", "slot", "source", r6("propensity").alias("propensity"))


def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Authors by identity: accounts whose name ends in 2, 3 or 4 are aliases of the first such account."""
    b = Base(spark, d)
    authors = b.posts.select("author_id").distinct()
    last = F.substring("author_id", -1, 1)
    some = authors.filter(last.isin("2", "3", "4")).select(F.col("author_id").alias("account_id"), last.alias("g"))
    aliases = some.join(some.groupBy("g").agg(F.min("account_id").alias("identity_id")), "g").select("account_id", "identity_id")
    rows = core.resolve(b.posts.select("post_id", "author_id"), "author_id", aliases)
    return rows.groupBy("identity_id").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("author_id").alias("accounts"))


def forge_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of forging each rater by days between the first reaction and the end of the log."""
    b = Base(spark, d)
    known = b.reactions.filter("ts > 0")
    seen = core.first_seen(known, "user_id", "ts")
    end = known.agg(F.max("ts").alias("t")).scalar()
    return seen.select("account_id", r6(core.forge_cost((end - F.col("first_seen")) / 86400.0)).alias("cost"))


def _pi(b: Base, column) -> DataFrame:
    return b.exposed.select("ordinal", r6(column).alias("pi"))


def propensity_logged(spark: SparkSession, d: str) -> DataFrame:
    return _pi(Base(spark, d), propensity.logged(EPSILON))


def propensity_position(spark: SparkSession, d: str) -> DataFrame:
    return _pi(Base(spark, d), propensity.position_based(EPSILON))


def propensity_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _pi(Base(spark, d), propensity.uniform(EPSILON))


def propensity_policy_softmax(spark: SparkSession, d: str) -> DataFrame:
    scores = Base(spark, d).exposures.select("user_id", "post_id", (F.col("slot") * F.lit(-0.1)).alias("score"))
    return propensity.policy_softmax(scores, EPSILON).select("user_id", "post_id", r6("pi").alias("pi"))


def ipw_weights(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).weighted.select("ordinal", r6("weight").alias("weight"))


def ipw_weights_lambda(spark: SparkSession, d: str) -> DataFrame:
    """Weights under a given influence of raters; raters of coordinate 0 have none of their own."""
    b = Base(spark, d)
    influence = b.clusters.filter("x <> 0").select("user_id", (F.col("x") + 4.0).alias("lambda"))
    return propensity.ipw_weights(b.exposed, propensity.logged(EPSILON), rater_lambda=influence).select("ordinal", r6("weight").alias("weight"))


def snipw_by_post(spark: SparkSession, d: str) -> DataFrame:
    return propensity.snipw(Base(spark, d).weighted, ["post_id"]).select("post_id", r6("estimate").alias("estimate"))


def _dr_pairs(b: Base) -> DataFrame:
    observed = b.reactions.groupBy("user_id", "post_id").agg(F.avg("value").alias("value"))
    imputed = b.reactions.groupBy("author_id").agg(F.avg("value").alias("imputed"))
    pairs = b.exposures.join(b.posts.select("post_id", "author_id"), "post_id").join(observed, ["user_id", "post_id"], "left").join(imputed, "author_id", "left")
    return pairs.select("post_id", "author_id", "value", F.coalesce("imputed", F.lit(0.0)).alias("imputed"), propensity.logged(EPSILON).alias("pi"))


def dr_reception(spark: SparkSession, d: str) -> DataFrame:
    return propensity.doubly_robust(_dr_pairs(Base(spark, d)), ["post_id"]).select("post_id", r6("estimate").alias("estimate"))


def dr_mean(spark: SparkSession, d: str) -> DataFrame:
    return propensity.doubly_robust(_dr_pairs(Base(spark, d)), []).select(r6("estimate").alias("estimate"))


def reception_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).reception.select("post_id", "cluster", r6("n_cp").alias("n_cp"), r6("r_emp").alias("r_emp"))


def _score(spark: SparkSession, d: str, s: Settings, **kw) -> DataFrame:
    b = Base(spark, d)
    return reception.score_posts(b.reacted_posts, b.reception, b.mu, s, **kw).select("post_id", r6("b_lcb").alias("b_lcb"))


def blcb_nash(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d, S)


def blcb_min(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d, replace(S, aggregator="min"))


def blcb_ede(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d, replace(S, aggregator="ede"))


def blcb_subtractive(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d, replace(S, aggregator="min", subtractive=True))


def blcb_out_of_band(spark: SparkSession, d: str) -> DataFrame:
    """Authority of reactions to out-of-band exposures scaled to a quarter."""
    b = Base(spark, d)
    rec = reception.cluster_reception(reception.scaled_by_source(b.weighted, "out_of_band", 0.25), b.clusters)
    return reception.score_posts(b.reacted_posts, rec, b.mu).select("post_id", r6("b_lcb").alias("b_lcb"))


def top_posts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty posts with the highest bridged score."""
    scored = blcb_nash(spark, d)
    return scored.orderBy(F.desc("b_lcb"), "post_id").limit(20)


def reception_org_exp(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    rows = reception.reception_by_source(b.weighted, b.clusters)
    return rows.select("post_id", "cluster", *[r6(c).alias(c) for c in ("org_w", "org_s", "exp_w", "exp_s")])


def _halves(b: Base) -> tuple[DataFrame, DataFrame]:
    return b.weighted.filter("ordinal % 2 = 0"), b.weighted.filter("ordinal % 2 = 1")


def calibrated_reception(spark: SparkSession, d: str) -> DataFrame:
    """The second half of the log calibrated by the pairs of the first."""
    b = Base(spark, d)
    first, second = _halves(b)

    def rows(w: DataFrame, model: DataFrame | None) -> DataFrame:
        return reception.calibrated(reception.cluster_reception(w, b.clusters), reception.reception_by_source(w, b.clusters), model)

    model = reception.calibration_moments(None, rows(first, None))
    return rows(second, model).select("post_id", "cluster", r6("n_cp").alias("n_cp"), r6("r_emp").alias("r_emp"), r6("pair_w").alias("pair_w"))


def anchor_ucb(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    anchor = reception.exploration_anchor(b.reactions, b.table("exposures"), b.posts)
    return reception.anchor_caps(b.posts, anchor).select("post_id", r6("cap").alias("cap"))


def blcb_capped(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    caps = reception.anchor_caps(b.posts, reception.exploration_anchor(b.reactions, b.table("exposures"), b.posts))
    return reception.score_posts(b.reacted_posts, b.reception, b.mu, S, caps=caps).select("post_id", r6("b_lcb").alias("b_lcb"))


def prior_first_window(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a first window: without history every author stands at the cluster's prior."""
    b = Base(spark, d)
    priors = reception.hierarchical_priors(b.reception, b.posts, b.mu, S)
    return reception.score_posts(b.reacted_posts, b.reception, b.mu, S, priors=priors).select("post_id", r6("b_lcb").alias("b_lcb"))


def prior_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Priors of the second half of the log from the author history of the first."""
    b = Base(spark, d)
    first, second = _halves(b)
    history = reception.by_author(reception.cluster_reception(first, b.clusters), b.posts)
    vouched = reception.by_author(reception.cluster_reception(b.weighted_vouches.filter("ordinal % 2 = 0"), b.clusters), b.posts)
    priors = reception.hierarchical_priors(reception.cluster_reception(second, b.clusters), b.reacted_posts, b.mu, S, history, vouched)
    return priors.select("post_id", r6(F.get("prior", F.lit(0))).alias("prior_0"), r6(F.get("prior", F.lit(1))).alias("prior_1"))


def author_history(spark: SparkSession, d: str) -> DataFrame:
    """Author history after both halves of the log, the first one decayed."""
    b = Base(spark, d)
    one, two = (reception.by_author(reception.cluster_reception(w, b.clusters), b.posts) for w in _halves(b))
    rows = reception.decayed_merge(one, two, ["author_id", "cluster"], ["total", "wt"], S.prior_decay)
    return rows.select("author_id", "cluster", r6("total").alias("total"), r6("wt").alias("wt"))


def depth_from_vouches(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    rec = reception.cluster_reception(b.weighted_vouches, b.clusters)
    return reception.depth_scores(rec).select("post_id", r6("depth").alias("depth"))


def keystone_grid(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    votes = b.reactions.join(b.clusters, "user_id")
    grid = reception.keystone_grid(reception.group_stats(votes, "post_id", "cluster", "value"))
    return grid.select("item", "penalty", "aggregator", r6("score").alias("score"))


def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Mean rating of each note by rater group (last character of the rater's name), empty groups NULL."""
    b = Base(spark, d)
    votes = b.table("ratings").filter(F.col("value").isin(-1.0, 0.0, 1.0))
    group = F.when(F.ascii(F.substring(F.lower(F.trim("raterId")), -1, 1)) % 2 == 0, "a").otherwise("b")
    wide = votes.withColumn("g", group).groupBy("noteId").pivot("g", ["a", "b"]).agg(F.avg("value"))
    return wide.select("noteId", r6("a").alias("mean_a"), r6("b").alias("mean_b"))


QUERIES = {
    f.__name__: f
    for f in (
        signal_mapping, channel_split, exposure_last_wins, identity_resolution, forge_cost, propensity_logged, propensity_position,
        propensity_uniform, propensity_policy_softmax, ipw_weights, ipw_weights_lambda, snipw_by_post, dr_reception, dr_mean,
        reception_by_cluster, blcb_nash, blcb_min, blcb_ede, blcb_subtractive, blcb_out_of_band, top_posts, reception_org_exp,
        calibrated_reception, anchor_ucb, blcb_capped, prior_first_window, prior_hierarchical, author_history, depth_from_vouches,
        keystone_grid, group_split,
    )
}

_DR = PRE + """, ob AS (SELECT user_id, post_id, avg(val) AS val FROM r GROUP BY 1, 2),
  im AS (SELECT author_id, avg(val) AS imputed FROM r GROUP BY 1),
  dp AS (SELECT p.post_id, coalesce(imputed, 0.0) AS imp, ob.val,
                least(1.0 / greatest(greatest(0.05, coalesce(propensity, 0.05)), 1e-12), 20.0) AS inv
         FROM e JOIN posts p USING (post_id) LEFT JOIN ob ON ob.user_id = e.user_id AND ob.post_id = e.post_id LEFT JOIN im ON im.author_id = p.author_id)
"""
_ANCHOR = PRE + """, an AS (SELECT author_id, sum(val) AS total, count(*) AS n FROM r
     WHERE (user_id, post_id) IN (SELECT (user_id, post_id) FROM exposures WHERE source = 'exploration') GROUP BY 1),
  cap AS (SELECT p.post_id, CASE WHEN n >= 1 THEN total / (n + 3.0) + 1.0 / sqrt(n + 3.0) END AS cap FROM posts p LEFT JOIN an USING (author_id))
"""


def _rec(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT post_id, cluster, sum(weight) AS n_cp, sum(weight * val) / sum(weight) AS r_emp
      FROM ({rows}) JOIN k USING (user_id) GROUP BY 1, 2 HAVING sum(weight) > 0)"""


def _split(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT post_id, cluster,
      sum(CASE WHEN source IS DISTINCT FROM 'exploration' THEN weight ELSE 0.0 END) AS org_w,
      sum(CASE WHEN source IS DISTINCT FROM 'exploration' THEN weight * val ELSE 0.0 END) AS org_s,
      sum(CASE WHEN source = 'exploration' THEN weight ELSE 0.0 END) AS exp_w,
      sum(CASE WHEN source = 'exploration' THEN weight * val ELSE 0.0 END) AS exp_s
      FROM ({rows}) JOIN k USING (user_id) GROUP BY 1, 2)"""


_CP = """cs AS (SELECT cluster, sum(n_cp * r_emp) AS s, sum(n_cp) AS w FROM {rec} GROUP BY 1),
  cp AS (SELECT c.cluster, mu + coalesce(w, 0.0) / (coalesce(w, 0.0) + 8.0) * (coalesce(s / w, mu) - mu) AS cp
         FROM (SELECT unnest([0, 1]) AS cluster) c LEFT JOIN cs USING (cluster), m)"""
_AH = """{name} AS (SELECT author_id, cluster, sum(n_cp * r_emp) AS total, sum(n_cp) AS wt FROM {rec} JOIN posts USING (post_id) GROUP BY 1, 2)"""

_PEN = {
    "none": "mean",
    "wald_count": "mean - 1.0 / sqrt(n + 1.0)",
    "wald_var": "mean - sqrt(vari / greatest(n, 1))",
    "wilson": "(((mean + 1.0) / 2.0 + 1.0 / (2.0 * n)) - sqrt(greatest(((mean + 1.0) / 2.0) * (1.0 - (mean + 1.0) / 2.0) / n + 1.0 / (4.0 * n * n), 0.0))) / (1.0 + 1.0 / n) * 2.0 - 1.0",
    "james_stein": "grand + n / (n + 8.0) * (mean - grand)",
}
_P = "least(greatest((y + 1.0) / 2.0, 1e-6), 1.0)"
_AGG = {
    "min": "min(y)",
    "mean": "avg(y)",
    "nash": f"exp(avg(ln({_P}))) * 2.0 - 1.0",
    "ede1": f"exp(avg(ln({_P}))) * 2.0 - 1.0",
    "ede4": f"pow(avg(pow({_P}, -3.0)), -1.0 / 3.0) * 2.0 - 1.0",
    "cvar": "list_avg(list_sort(list(y))[1:CAST(greatest(ceil(count(*) * 0.5), 1) AS BIGINT)])",
}
_GRID = PRE + """, gs AS (SELECT post_id AS item, cluster, avg(val) AS mean, CAST(count(*) AS DOUBLE) AS n, var_pop(val) AS vari,
                              sum(sum(val)) OVER (PARTITION BY post_id) / sum(count(*)) OVER (PARTITION BY post_id) AS grand
                       FROM r JOIN k USING (user_id) GROUP BY post_id, cluster)
""" + " UNION ALL ".join(
    f"SELECT item, '{p}' AS penalty, '{a}' AS aggregator, round({agg}, 6) + 0.0 AS score FROM (SELECT item, {pen} AS y FROM gs) GROUP BY item"
    for p, pen in _PEN.items()
    for a, agg in _AGG.items()
)

SQL = {
    "signal_mapping": PRE + "SELECT kind, count(*) AS n, round(sum(val), 6) + 0.0 AS total FROM r0 WHERE val IS NOT NULL AND user_id IS NOT NULL AND post_id IS NOT NULL GROUP BY 1",
    "channel_split": PRE + """SELECT 'approval' AS channel, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(val), 6) + 0.0 AS mean_value FROM r
        UNION ALL SELECT 'vouch', count(*), count(DISTINCT user_id), round(avg(val), 6) + 0.0 FROM v""",
    "exposure_last_wins": PRE + "SELECT user_id, post_id, ordinal, slot, source, round(propensity, 6) + 0.0 AS propensity FROM e",
    "identity_resolution": """WITH a AS (SELECT DISTINCT author_id FROM posts), s AS (SELECT author_id, right(author_id, 1) AS g FROM a WHERE right(author_id, 1) IN ('2', '3', '4')),
        i AS (SELECT author_id, min(author_id) OVER (PARTITION BY g) AS ident FROM s)
        SELECT coalesce(ident, p.author_id) AS identity_id, count(*) AS posts, count(DISTINCT p.author_id) AS accounts FROM posts p LEFT JOIN i ON i.author_id = p.author_id GROUP BY 1""",
    "forge_cost": PRE + "SELECT user_id AS account_id, round(ln(1.0 + ((SELECT max(ts) FROM r WHERE ts > 0) - min(ts)) / 86400.0), 6) + 0.0 AS cost FROM r WHERE ts > 0 GROUP BY 1",
    "propensity_logged": PRE + "SELECT ordinal, round(pi, 6) + 0.0 AS pi FROM x",
    "propensity_position": PRE + "SELECT ordinal, round(greatest(0.05, pow(0.9, greatest(coalesce(slot, 0), 0))), 6) + 0.0 AS pi FROM x",
    "propensity_uniform": PRE + "SELECT ordinal, CAST(0.05 AS DOUBLE) AS pi FROM x",
    "propensity_policy_softmax": PRE + """SELECT user_id, post_id, round(greatest(0.05, exp(slot * -0.1 - max(slot * -0.1) OVER (PARTITION BY user_id))
        / sum(exp(slot * CAST(-0.1 AS DOUBLE))) OVER (PARTITION BY user_id) * exp(max(slot * CAST(-0.1 AS DOUBLE)) OVER (PARTITION BY user_id))), 6) + 0.0 AS pi FROM e""",
    "ipw_weights": PRE + "SELECT ordinal, round(weight, 6) + 0.0 AS weight FROM w",
    "ipw_weights_lambda": PRE + """, l AS (SELECT ordinal, least(1.0 / greatest(pi, 1e-12), 20.0) * CASE WHEN k.x <> 0 THEN k.x + 4.0 ELSE 0.15 / (SELECT count(*) FROM x) END AS raw
        FROM x JOIN k USING (user_id)) SELECT ordinal, round(raw / avg(raw) OVER (), 6) + 0.0 AS weight FROM l""",
    "snipw_by_post": PRE + "SELECT post_id, round(sum(weight * val) / sum(weight), 6) + 0.0 AS estimate FROM w GROUP BY 1",
    "dr_reception": _DR + "SELECT post_id, round(avg(imp + coalesce(inv * (val - imp), 0.0)), 6) + 0.0 AS estimate FROM dp GROUP BY 1",
    "dr_mean": _DR + "SELECT round(avg(imp + coalesce(inv * (val - imp), 0.0)), 6) + 0.0 AS estimate FROM dp",
    "reception_by_cluster": PRE + "SELECT post_id, cluster, round(n_cp, 6) + 0.0 AS n_cp, round(r_emp, 6) + 0.0 AS r_emp FROM rec",
    "blcb_nash": PRE + "SELECT post_id, round(b_lcb, 6) + 0.0 AS b_lcb FROM sc",
    "blcb_min": PRE + "SELECT post_id, round(min(val), 6) + 0.0 AS b_lcb FROM sh GROUP BY 1",
    "blcb_ede": PRE + "SELECT post_id, round(pow(avg(pow(least(greatest((val + 1.0) / 2.0, 1e-6), 1.0), -3.0)), -1.0 / 3.0) * 2.0 - 1.0, 6) + 0.0 AS b_lcb FROM sh GROUP BY 1",
    "blcb_subtractive": PRE + "SELECT post_id, round(min(coalesce(emp, mu) - 1.0 / sqrt(n + 1.0)), 6) + 0.0 AS b_lcb FROM pc, m GROUP BY 1",
    "blcb_out_of_band": PRE + ", " + _rec("ro", "SELECT user_id, post_id, val, weight * CASE WHEN source = 'out_of_band' THEN 0.25 ELSE 1.0 END AS weight FROM w")
    + nash("""SELECT rp.post_id, mu + coalesce(n_cp, 0.0) / (coalesce(n_cp, 0.0) + 8.0) * (coalesce(r_emp, mu) - mu) AS val
              FROM rp CROSS JOIN (SELECT unnest([0, 1]) AS cluster) c LEFT JOIN ro ON ro.post_id = rp.post_id AND ro.cluster = c.cluster, m"""),
    "top_posts": PRE + "SELECT post_id, round(b_lcb, 6) + 0.0 AS b_lcb FROM sc ORDER BY 2 DESC, 1 LIMIT 20",
    "reception_org_exp": PRE + ", " + _split("sp", "SELECT * FROM w") + """SELECT post_id, cluster, round(org_w, 6) + 0.0 AS org_w, round(org_s, 6) + 0.0 AS org_s,
        round(exp_w, 6) + 0.0 AS exp_w, round(exp_s, 6) + 0.0 AS exp_s FROM sp""",
    "calibrated_reception": PRE + ", " + _split("s1", "SELECT * FROM w WHERE ordinal % 2 = 0") + ", " + _split("s2", "SELECT * FROM w WHERE ordinal % 2 = 1")
    + ", " + _rec("r2", "SELECT * FROM w WHERE ordinal % 2 = 1") + """,
      pr AS (SELECT cluster, org_s / org_w AS x, exp_s / exp_w AS y, exp_w AS g FROM s1 WHERE org_w > 0 AND exp_w > 0),
      mo AS (SELECT cluster, sum(g) AS sw, sum(g * x) AS sx, sum(g * y) AS sy, sum(g * x * x) AS sxx, sum(g * x * y) AS sxy FROM pr GROUP BY 1),
      li AS (SELECT cluster, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS level
             FROM mo WHERE sw >= 8 AND abs(sw * sxx - sx * sx) >= 1e-9)
      SELECT r2.post_id, r2.cluster, round(n_cp, 6) + 0.0 AS n_cp,
             round(coalesce(CASE WHEN exp_w > 0 THEN exp_s / exp_w END, level + slope * org_s / CASE WHEN org_w > 0 THEN org_w END, CASE WHEN org_w > 0 THEN org_s / org_w END, r_emp), 6) + 0.0 AS r_emp,
             round(CASE WHEN org_w > 0 AND exp_w > 0 THEN exp_w END, 6) + 0.0 AS pair_w
      FROM r2 JOIN s2 ON s2.post_id = r2.post_id AND s2.cluster = r2.cluster LEFT JOIN li ON li.cluster = r2.cluster""",
    "anchor_ucb": _ANCHOR + "SELECT post_id, round(cap, 6) + 0.0 AS cap FROM cap",
    "blcb_capped": _ANCHOR + nash("SELECT sh.post_id, least(val, coalesce(cap, val)) AS val FROM sh JOIN cap USING (post_id)"),
    "prior_first_window": PRE + ", " + _CP.format(rec="rec") + nash("SELECT post_id, cp + n / (n + 8.0) * (coalesce(emp, cp) - cp) AS val FROM pc JOIN cp USING (cluster)"),
    "prior_hierarchical": PRE + ", " + _rec("r1", "SELECT * FROM w WHERE ordinal % 2 = 0") + ", " + _rec("r2", "SELECT * FROM w WHERE ordinal % 2 = 1")
    + ", " + _rec("rv", "SELECT * FROM wv WHERE ordinal % 2 = 0") + ", " + _CP.format(rec="r2") + ", " + _AH.format(name="h", rec="r1") + ", " + _AH.format(name="hv", rec="rv")
    + """, pr AS (SELECT rp.post_id, cp.cluster, CASE WHEN h.wt > 0 THEN least(cp + h.wt / (h.wt + 8.0) * (h.total / h.wt - cp),
                          cp + coalesce(greatest(hv.total / hv.wt, 0.0) * hv.wt / (hv.wt + 8.0), 0.0)) ELSE cp END AS p
                  FROM rp CROSS JOIN cp LEFT JOIN h ON h.author_id = rp.author_id AND h.cluster = cp.cluster
                  LEFT JOIN hv ON hv.author_id = rp.author_id AND hv.cluster = cp.cluster)
         SELECT post_id, round(max(CASE WHEN cluster = 0 THEN p END), 6) + 0.0 AS prior_0, round(max(CASE WHEN cluster = 1 THEN p END), 6) + 0.0 AS prior_1 FROM pr GROUP BY 1""",
    "author_history": PRE + ", " + _rec("r1", "SELECT * FROM w WHERE ordinal % 2 = 0") + ", " + _rec("r2", "SELECT * FROM w WHERE ordinal % 2 = 1")
    + ", " + _AH.format(name="h1", rec="r1") + ", " + _AH.format(name="h2", rec="r2")
    + """SELECT author_id, cluster, round(coalesce(h1.total, 0.0) * 0.7 + coalesce(h2.total, 0.0), 6) + 0.0 AS total, round(coalesce(h1.wt, 0.0) * 0.7 + coalesce(h2.wt, 0.0), 6) + 0.0 AS wt
         FROM h1 FULL JOIN h2 USING (author_id, cluster)""",
    "depth_from_vouches": PRE + ", " + _rec("rv", "SELECT * FROM wv") + """, dv AS (SELECT p.post_id, coalesce(n_cp, 0.0) / (coalesce(n_cp, 0.0) + 8.0) * coalesce(r_emp, 0.0) AS y
          FROM (SELECT DISTINCT post_id FROM rv) p CROSS JOIN (SELECT unnest([0, 1]) AS cluster) c LEFT JOIN rv ON rv.post_id = p.post_id AND rv.cluster = c.cluster)
          SELECT post_id, round(least(greatest(exp(avg(ln(least(greatest((y + 1.0) / 2.0, 1e-6), 1.0)))), 0.0), 1.0), 6) + 0.0 AS depth FROM dv GROUP BY 1""",
    "keystone_grid": _GRID,
    "group_split": """SELECT noteId, round(avg("value") FILTER (ascii(right(lower(trim(raterId)), 1)) % 2 = 0), 6) + 0.0 AS mean_a,
        round(avg("value") FILTER (ascii(right(lower(trim(raterId)), 1)) % 2 = 1), 6) + 0.0 AS mean_b FROM ratings WHERE "value" IN (-1, 0, 1) GROUP BY 1""",
}
