"""Queries of rater influence, collusion, budgets, auditions and monitors."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.operators import economy, monitor, rater, reception
from brindle.plans.base import PRE, Base, r6
from brindle.session import cut

S = Settings()


class Raters(Base):
    """Base with the closed-form opinion coordinates as factors of users."""

    @property
    def users(self) -> DataFrame:
        return self.clusters.select("user_id")

    @property
    def factors(self) -> DataFrame:
        return self.clusters.select("user_id", F.array("x").alias("x"))

    @property
    def edges(self) -> DataFrame:
        return rater.trust_edges(self.reactions, self.users, self.factors)

    @property
    def influence(self) -> DataFrame:
        """A closed-form influence of raters, summing to 1."""
        raw = self.clusters.select("user_id", (F.abs("x") + 1.0).alias("l"))
        return raw.select("user_id", (F.col("l") / raw.agg(F.sum("l").alias("s")).scalar()).alias("lambda"))

    @property
    def strength(self) -> DataFrame:
        return self.scores.select("post_id", F.col("b_lcb").alias("strength"))

    @property
    def aligned(self) -> DataFrame:
        """Reactions with a closed-form alignment: coordinate of the user times that of the author."""
        last = F.ascii(F.substring("author_id", -1, 1)) % 7 - 3
        return self.exposed.join(self.clusters, "user_id").withColumn("xy", F.col("x") * last.cast("double") / 9.0)


def trust_edges(spark: SparkSession, d: str) -> DataFrame:
    return Raters(spark, d).edges.select("src", "dst", r6("t").alias("t"))


def out_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rater.out_diversity(Raters(spark, d).edges).select("src", r6("w").alias("w"))


def eigentrust_10(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    edges = cut(b.edges)
    out = rater.eigentrust(b.users, edges, S, iterations=10, transmit=rater.out_diversity(edges))
    return out.select("user_id", F.round(F.col("lambda") * 1000, 6).alias("lambda_k"))


def eigentrust_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Teleport only to raters of coordinate 3, weights clipped at five times the mean."""
    b = Raters(spark, d)
    seeds = b.clusters.filter("x = 3").select("user_id")
    seeds = seeds.select("user_id", (F.lit(1.0) / seeds.agg(F.count(F.lit(1)).alias("n")).scalar()).alias("p"))
    out = rater.eigentrust(b.users, b.edges, S, iterations=5, seeds=seeds, clip=5.0)
    return out.select("user_id", F.round(F.col("lambda") * 1000, 6).alias("lambda_k"))


RINGS, RING_STEPS = (5, 20, 50, 100), 10


def ring_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Percentile of a boosted author under rings of 5 to 100 puppets after ten trust steps, without and with the diversity defence."""
    b = Raters(spark, d)
    edges, users = cut(b.edges), cut(b.users)
    target = edges.agg(F.min("dst")).first()[0]
    out = None
    for size in RINGS:
        puppets = spark.range(size).select(F.concat(F.lit("puppet:"), F.col("id").cast("string")).alias("user_id"))
        all_edges, everyone = cut(rater.ring(edges, puppets, target)), users.unionByName(puppets)
        for defended in (False, True):
            weights = rater.eigentrust(everyone, all_edges, S, iterations=RING_STEPS, transmit=rater.out_diversity(all_edges) if defended else None)
            # weights within rounding of the target's own are no smaller
            row = rater.percentile_of(weights.withColumn("lambda", F.round(F.col("lambda") * 1000, 9)), target)
            row = row.select(F.lit(size).alias("ring"), F.lit(defended).alias("defended"), F.round("percentile", 4).alias("percentile"))
            out = row if out is None else out.unionByName(row)
    return out


def quality_weight(spark: SparkSession, d: str) -> DataFrame:
    """Against posts' mean value as bridged quality and users' mean as bias."""
    b = Raters(spark, d)
    post = b.reactions.groupBy("post_id").agg(F.avg("value").alias("b_p"))
    user = b.reactions.groupBy("user_id").agg(F.avg("value").alias("b_u"))
    rows = b.reactions.join(post, "post_id").join(user, "user_id")
    out = rater.quality_weight(rows.select("user_id", (F.col("value") - F.col("b_u")).alias("adj"), "b_p"))
    return out.select("user_id", F.round(F.col("quality") * 1000, 6).alias("quality_k"))


def lambda_blend(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    quality = b.clusters.filter("x >= 0").select("user_id", (F.col("x") / b.clusters.agg(F.sum(F.when(F.col("x") >= 0, F.col("x"))).alias("s")).scalar()).alias("quality"))
    return rater.blend(b.influence, quality, S.quality_mix).select("user_id", F.round(F.col("lambda") * 1000, 6).alias("lambda_k"))


def scout_precision(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    return rater.scout_precision(b.reactions, b.strength, S.scout_alpha).select("user_id", r6("scout").alias("scout"))


def satisfaction(spark: SparkSession, d: str) -> DataFrame:
    return rater.satisfaction(Raters(spark, d).aligned).select("user_id", r6("satisfaction").alias("satisfaction"))


def lambda_recycled(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    out = rater.recycle(b.influence, rater.satisfaction(b.aligned), S.zeta)
    return out.select("user_id", F.round(F.col("lambda") * 1000, 6).alias("lambda_k"))


def recycling_verified(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    out = rater.recycle(b.influence, rater.verified_satisfaction(b.aligned), S.zeta)
    return out.select("user_id", F.round(F.col("lambda") * 1000, 6).alias("lambda_k"))


def coordination_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rater.coordination(Raters(spark, d).reactions).select("post_id", r6("coordination").alias("coordination"))


def collusion_fraction(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    return rater.manufactured_fraction(rater.support(b.reactions), b.clusters).select("author_id", r6("fraction").alias("fraction"))


def collusion_two_windows(spark: SparkSession, d: str) -> DataFrame:
    """Support after both halves of the log, the first one decayed, and the fraction without the opinion axis."""
    b = Raters(spark, d)
    one, two = (rater.support(b.reactions.filter(f"ordinal % 2 = {k}")) for k in (0, 1))
    state = reception.decayed_merge(one, two, ["author_id", "user_id"], ["support"], 0.6)
    return rater.manufactured_fraction(state).select("author_id", r6("fraction").alias("fraction"))


def penalised_blcb(spark: SparkSession, d: str) -> DataFrame:
    """Bridged scores less a quarter of the coordination and half of the manufactured fraction."""
    b = Raters(spark, d)
    scored = b.scores.select("post_id", "b_lcb").join(b.reacted_posts, "post_id")
    parts = [
        (rater.coordination(b.reactions), "post_id", "coordination", 0.25),
        (rater.manufactured_fraction(rater.support(b.reactions), b.clusters), "author_id", "fraction", 0.5),
    ]
    return rater.penalise(scored, parts).select("post_id", r6("b_lcb").alias("b_lcb"))


def _identities(b: Raters) -> DataFrame:
    return b.posts.select("post_id", F.col("author_id").alias("identity_id"))


def _exposure(b: Raters, half: int | None = None) -> DataFrame:
    rows = b.table("exposures")
    return economy.exposure_counts(rows if half is None else rows.filter(f"ordinal % 2 = {half}"))


def budget_replenish(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    out = economy.replenish(economy.earned(_identities(b), b.strength, _exposure(b)), None, S)
    return out.select("identity_id", r6("budget").alias("budget"))


def budget_share(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    out = economy.replenish(economy.earned(_identities(b), b.strength, _exposure(b)), None, replace(S, budget_share=True))
    return out.select("identity_id", r6("budget").alias("budget"))


def budget_memory_two_windows(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    s = replace(S, budget_memory=0.5)
    first = economy.replenish(economy.earned(_identities(b), b.strength, _exposure(b, 0)), None, s)
    return economy.replenish(economy.earned(_identities(b), b.strength, _exposure(b, 1)), first, s).select("identity_id", r6("budget").alias("budget"))


def budget_streaming(spark: SparkSession, d: str) -> DataFrame:
    """Streaming credit over two windows."""
    b = Raters(spark, d)
    conf = economy.confidence(b.reception)
    one = economy.streaming_credit(_identities(b), b.strength, _exposure(b, 0), conf)
    two = economy.streaming_credit(_identities(b), b.strength, _exposure(b, 1), conf, one)
    gained = two.groupBy("identity_id").agg(F.sum("increment").alias("earned"))
    return economy.replenish(gained, None, S).select("identity_id", r6("budget").alias("budget"))


def replicator_gain(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    return economy.replicator_gain(_identities(b), b.strength, S).select(r6("gain").alias("gain"))


def amplification_collar(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    out = economy.collar(b.strength, _exposure(b), b.reactions, kappa=0.5)
    return out.select("post_id", r6("collar").alias("collar"), r6("strength").alias("strength"))


def audition_posterior(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    out = economy.observe(None, economy.normalised_rewards(b.scores, b.exposures), S)
    return out.select("post_id", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "closed")


def thompson_draws(spark: SparkSession, d: str) -> DataFrame:
    b = Raters(spark, d)
    return economy.thompson(economy.observe(None, economy.normalised_rewards(b.scores, b.exposures), S), F.col("post_id")).select("post_id", "draw")


def gini_lambda(spark: SparkSession, d: str) -> DataFrame:
    return monitor.gini(Raters(spark, d).influence).select(r6("gini").alias("gini"))


def n_eff(spark: SparkSession, d: str) -> DataFrame:
    return monitor.effective_raters(Raters(spark, d).influence).select(r6("n_eff").alias("n_eff"))


def _days(b: Raters) -> DataFrame:
    rows = b.reactions.filter("ts > 0").withColumn("day", F.floor(F.col("ts") / 86400).cast("int"))
    return rows.groupBy("author_id", "day").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n"))


def saturation_depth(spark: SparkSession, d: str) -> DataFrame:
    """Per author: prior from the decay of the daily variance of reactions."""
    return monitor.saturation_prior(_days(Raters(spark, d)), ["author_id"], "day", "v").select("author_id", r6("prior").alias("prior"))


def lipschitz(spark: SparkSession, d: str) -> DataFrame:
    """Per author: change of the daily mean value against change of the daily number of reactions."""
    return monitor.sensitivity(_days(Raters(spark, d)), ["author_id"], "day", "m", "n").select("author_id", r6("lipschitz").alias("lipschitz"))


def endogenous_shift(spark: SparkSession, d: str) -> DataFrame:
    """Per cluster: drift between the halves of the log under exploration against the rest."""
    b = Raters(spark, d)
    explored = F.coalesce(F.col("source") == "exploration", F.lit(False))
    half = F.col("ordinal") % 2

    def mean(e, h):
        return F.avg(F.when(e & (half == h), F.col("value")))

    rows = b.exposed.join(b.clusters, "user_id").groupBy("cluster").agg(
        F.abs(mean(explored, 0) - mean(explored, 1)).alias("x"), F.abs(mean(~explored, 0) - mean(~explored, 1)).alias("p")
    )
    return rows.select("cluster", r6(monitor.endogenous_shift(F.col("x"), F.col("p"))).alias("shift"))


def portfolio_allocate(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the randomization arms after observing the mean value reached under each source of exposure."""
    b = Raters(spark, d)
    arms = b.exposed.filter("source is not null").groupBy("source").agg(F.avg("value").alias("m")).orderBy("source").collect()
    portfolio = economy.RandomizationPortfolio([r["source"] for r in arms])
    for r in arms:
        portfolio.observe(r["source"], r["m"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in portfolio.allocate().items()], "arm string, share double")


def _few_reactors(b: Raters) -> DataFrame:
    """Reactors of the posts under audition by vouch: those whose pairs the registered query looks at."""
    return b.vouches.select("user_id").distinct()


def coreaction_edges(spark: SparkSession, d: str) -> DataFrame:
    """Co-reaction graph of the vouchers over the vouch channel."""
    b = Raters(spark, d)
    return monitor.coreaction_edges(b.vouches, _few_reactors(b)).filter("w > 0").select("u", "v", r6("w").alias("w"))


def morans_i(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of the vouchers' opinion coordinates on their co-reaction graph."""
    b = Raters(spark, d)
    values = _few_reactors(b).select("user_id", (F.ascii(F.substring("user_id", -1, 1)) % 7 - 3).cast("double").alias("value"))
    return monitor.morans_i_by_blocks(b.vouches, cut(values)).select(r6("morans_i").alias("morans_i"))


def morans_i_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of all reactors' opinion coordinates on their co-reaction graph over the approval channel."""
    b = Raters(spark, d)
    return monitor.morans_i_by_blocks(b.reactions, b.clusters.select("user_id", F.col("x").alias("value"))).select(r6("morans_i").alias("morans_i"), "edges")


QUERIES = {
    f.__name__: f
    for f in (
        trust_edges, out_diversity, eigentrust_10, eigentrust_seeded, ring_sweep, quality_weight, lambda_blend, scout_precision, satisfaction,
        lambda_recycled, recycling_verified, coordination_jaccard, collusion_fraction, collusion_two_windows, penalised_blcb, budget_replenish,
        budget_share, budget_memory_two_windows, budget_streaming, replicator_gain, amplification_collar, audition_posterior, thompson_draws,
        gini_lambda, n_eff, saturation_depth, lipschitz, endogenous_shift, portfolio_allocate, coreaction_edges, morans_i, morans_i_approvals,
    )
}

_T = PRE + """, ed AS (SELECT user_id AS src, author_id AS dst, sum(val) AS v FROM r WHERE val > 0 AND author_id <> user_id
     AND author_id IN (SELECT user_id FROM k) GROUP BY 1, 2),
  ev AS (SELECT src, dst, v * abs(a.x - b.x) AS v FROM ed JOIN k a ON a.user_id = src JOIN k b ON b.user_id = dst),
  t AS (SELECT src, dst, CASE WHEN sum(v) OVER (PARTITION BY src) > 0 THEN v / sum(v) OVER (PARTITION BY src) ELSE v END AS t FROM ev),
  dv AS (SELECT src, CASE WHEN count(*) FILTER (t > 0) > 1 THEN least(greatest(-sum(CASE WHEN t > 0 THEN t * ln(t) END) / ln(count(*) FILTER (t > 0)), 0.0), 1.0) ELSE 0.0 END AS w FROM t GROUP BY 1)
"""


def _iterated(n: int, edge: str, tele: str, passed: str = "l") -> str:
    """Unrolled trust iteration over users u(user_id, p) and edges g(src, dst, t)."""
    out = f", g AS MATERIALIZED ({edge}), u AS MATERIALIZED ({tele}), l0 AS MATERIALIZED (SELECT user_id, 1.0 / count(*) OVER () AS l FROM u)"
    for i in range(1, n + 1):
        out += f""", i{i} AS MATERIALIZED (SELECT u.user_id, 0.15 * p + 0.85 * coalesce(s, 0.0) AS l FROM u LEFT JOIN
            (SELECT dst, sum(t * {passed}) AS s FROM g JOIN l{i - 1} ON user_id = src GROUP BY 1) q ON dst = u.user_id),
            l{i} AS MATERIALIZED (SELECT user_id, l / sum(l) OVER () AS l FROM i{i})"""
    return out


def _ring_sql() -> str:
    """The trust iteration of every ring, without and with the defence; names get the number of the case."""
    out, rows = _T + ", tg AS (SELECT min(dst) AS target FROM t)", []
    for size in RINGS:
        for defended in (False, True):
            i = len(rows)
            puppets = f"(SELECT 'puppet:' || i AS user_id FROM range({size}) p(i))"
            edge = "SELECT src, dst, t * w AS t FROM t JOIN dv USING (src) WHERE t * w > 0" if defended else f"SELECT src, dst, t FROM t WHERE t > 0 UNION ALL SELECT user_id, target, 1.0 FROM {puppets}, tg"
            case = _iterated(RING_STEPS, edge, f"SELECT user_id, 1.0 / count(*) OVER () AS p FROM (SELECT user_id FROM k UNION ALL SELECT user_id FROM {puppets})")
            for name in ("g", "u", *[f"{x}{n}" for x in "li" for n in range(RING_STEPS + 1)]):
                case = re.sub(rf"\b{name}\b(?= AS MAT| ON| JOIN| LEFT|\.| q|\))", f"{name}_{i}", case)
            out += case
            own = f"(SELECT round(l * 1000, 9) FROM l{RING_STEPS}_{i}, tg WHERE user_id = target)"
            rows.append(f"SELECT {size} AS ring, {str(defended).lower()} AS defended, round(avg(CASE WHEN round(l * 1000, 9) < {own} THEN 100.0 ELSE 0.0 END), 4) AS percentile FROM l{RING_STEPS}_{i}")
    return out + " " + " UNION ALL ".join(rows)


_INF = PRE + """, inf AS (SELECT user_id, (abs(x) + 1.0) / sum(abs(x) + 1.0) OVER () AS l FROM k)"""
_ALI = _INF + """, al AS (SELECT x.*, k.x * CAST(ascii(right(author_id, 1)) % 7 - 3 AS DOUBLE) / 9.0 AS xy FROM x JOIN k USING (user_id)),
  sa AS (SELECT user_id, avg(xy) AS s FROM al GROUP BY 1)"""
_REC = """, mv AS (SELECT inf.user_id, l, l * greatest(1.0 + 0.3 * ((SELECT avg(s) FROM {s}) - coalesce(s, (SELECT avg(s) FROM {s}))), 0.0) AS m FROM inf LEFT JOIN {s} USING (user_id))
  SELECT user_id, round(m * sum(l) OVER () / sum(m) OVER () * 1000, 6) AS lambda_k FROM mv"""
_CO = """, ap AS (SELECT user_id, post_id, min(ordinal) AS first FROM r WHERE val > 0 GROUP BY 1, 2),
  hd AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY first) AS n FROM ap QUALIFY n <= 200),
  st AS (SELECT user_id, list(post_id) AS s FROM ap GROUP BY 1),
  prs AS (SELECT a.post_id, a.user_id AS u, b.user_id AS v FROM hd a JOIN hd b ON a.post_id = b.post_id AND a.n < b.n),
  dp AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM prs),
  jc AS (SELECT dp.u, dp.v, len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) AS j
         FROM dp JOIN st a ON a.user_id = dp.u JOIN st b ON b.user_id = dp.v),
  cm AS (SELECT post_id, avg(j) AS j FROM prs JOIN jc ON jc.u = least(prs.u, prs.v) AND jc.v = greatest(prs.u, prs.v) GROUP BY 1),
  co AS (SELECT post_id, CASE WHEN k3 < 3 THEN 0.0 ELSE coalesce(j, 0.0) END AS c FROM (SELECT post_id, count(*) AS k3 FROM hd GROUP BY 1) LEFT JOIN cm USING (post_id))"""
_MF = """, su AS (SELECT author_id, user_id, CAST(count(*) AS DOUBLE) AS s FROM r WHERE val > 0 GROUP BY 1, 2),
  sm AS (SELECT su.*, max(s) OVER (PARTITION BY author_id) AS top, sum(s) OVER (PARTITION BY author_id) AS total FROM su),
  mf AS (SELECT author_id, any_value(top) AS top, any_value(total) AS total, sum(s * s / top) FILTER (s >= 2) AS mass, count(*) FILTER (s >= 2) AS n,
                sum(s * s / top * x) FILTER (s >= 2) / sum(s * s / top) FILTER (s >= 2) AS mx, sum(s * s / top * x * x) FILTER (s >= 2) / sum(s * s / top) FILTER (s >= 2) AS mxx
         FROM sm JOIN k USING (user_id) GROUP BY 1),
  fr AS (SELECT author_id, CASE WHEN total > 0 AND top >= 2 THEN coalesce(mass, 0.0) / total *
            CASE WHEN n >= 2 THEN least(1.0, sqrt(greatest(mxx - mx * mx, 0.0)) / (SELECT stddev_pop(x) FROM k)) ELSE 1.0 END ELSE 0.0 END AS f FROM mf)"""


def _bud(exposure: str, base: str = "10.0", name: str = "b") -> str:
    return f"""{name} AS (SELECT p.author_id AS identity_id, sum(greatest(coalesce(b_lcb, 0.0), 0.0) * coalesce(n, 0)) AS earned FROM posts p
       LEFT JOIN sc USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS n FROM exposures {exposure} GROUP BY 1) ex USING (post_id) GROUP BY 1)"""


_DAYS = PRE + """, dy AS (SELECT author_id, CAST(floor(ts / 86400) AS INT) AS day, avg(val) AS m, var_pop(val) AS v, count(*) AS n FROM r WHERE ts > 0 GROUP BY 1, 2)"""
_GRAPH = PRE + """, cl AS (SELECT user_id, post_id, avg(val) AS v FROM v GROUP BY 1, 2), np AS (SELECT count(DISTINCT post_id) AS p FROM cl),
  us AS (SELECT user_id, sum(v) / p AS m, sqrt(greatest(sum(v * v) - sum(v) * sum(v) / p, 0.0)) AS nn, p FROM cl, np GROUP BY user_id, p),
  ab AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.v * b.v) AS ab FROM cl a JOIN cl b ON a.post_id = b.post_id AND a.user_id <> b.user_id GROUP BY 1, 2),
  gr AS (SELECT ab.u, ab.v, greatest((ab - a.p * a.m * b.m) / (greatest(a.nn, 1e-9) * greatest(b.nn, 1e-9)), 0.0) AS w
         FROM ab JOIN us a ON a.user_id = ab.u JOIN us b ON b.user_id = ab.v)"""
_GRAPH_R = _GRAPH.replace("FROM v GROUP BY", "FROM r GROUP BY")

SQL = {
    "ring_sweep": _ring_sql(),
    "trust_edges": _T + "SELECT src, dst, round(t, 6) + 0.0 AS t FROM t",
    "out_diversity": _T + "SELECT src, round(w, 6) + 0.0 AS w FROM dv",
    "eigentrust_10": _T + _iterated(10, "SELECT src, dst, t * w AS t FROM t JOIN dv USING (src) WHERE t * w > 0", "SELECT user_id, 1.0 / count(*) OVER () AS p FROM k")
    + " SELECT user_id, round(l * 1000, 6) AS lambda_k FROM l10",
    "eigentrust_seeded": _T + _iterated(5, "SELECT src, dst, t FROM t WHERE t > 0", "SELECT user_id, CASE WHEN x = 3 THEN 1.0 / count(*) FILTER (x = 3) OVER () ELSE 0.0 END AS p FROM k",
        "least(l, 5.0 / (SELECT count(*) FROM k))") + " SELECT user_id, round(l * 1000, 6) AS lambda_k FROM l5",
    "quality_weight": PRE + """, a AS (SELECT user_id, val - avg(val) OVER (PARTITION BY user_id) AS adj, avg(val) OVER (PARTITION BY post_id) AS bp FROM r),
        q AS (SELECT user_id, 0.15 + 0.85 * greatest(CASE WHEN count(*) >= 2 AND stddev_pop(adj) >= 1e-9 AND stddev_pop(bp) >= 1e-9 THEN covar_pop(adj, bp) / (stddev_pop(adj) * stddev_pop(bp)) ELSE 0.0 END, 0.0) AS q FROM a GROUP BY 1)
        SELECT user_id, round(q / sum(q) OVER () * 1000, 6) AS quality_k FROM q""",
    "lambda_blend": _INF + """, bl AS (SELECT inf.user_id, 0.5 * l + 0.5 * CASE WHEN x >= 0 THEN x / (SELECT sum(x) FROM k WHERE x >= 0) ELSE 0.0 END AS b FROM inf JOIN k USING (user_id))
        SELECT user_id, round(b / sum(b) OVER () * 1000, 6) AS lambda_k FROM bl""",
    "scout_precision": PRE + """, pk AS (SELECT user_id, b_lcb, exp(-0.5 * (row_number() OVER (PARTITION BY post_id ORDER BY ts, ordinal) - 1)) AS w FROM r JOIN sc USING (post_id) WHERE val > 0)
        SELECT user_id, round(CASE WHEN sum(w) > 0 THEN sum(w * b_lcb) / sum(w) ELSE 0.0 END, 6) + 0.0 AS scout FROM pk GROUP BY 1""",
    "satisfaction": _ALI + " SELECT user_id, round(s, 6) + 0.0 AS satisfaction FROM sa",
    "lambda_recycled": _ALI + _REC.format(s="sa"),
    "recycling_verified": _ALI + """, oe AS (SELECT user_id, avg(xy) FILTER (source IS DISTINCT FROM 'exploration') AS o, avg(xy) FILTER (source = 'exploration') AS e FROM al GROUP BY 1),
        ov AS (SELECT *, avg(o) OVER () AS bar FROM oe WHERE o IS NOT NULL), sv AS (SELECT user_id, bar - greatest(coalesce(e, bar) - o, 0.0) AS s FROM ov)""" + _REC.format(s="sv"),
    "coordination_jaccard": PRE + _CO + " SELECT post_id, round(c, 6) + 0.0 AS coordination FROM co",
    "collusion_fraction": PRE + _MF + " SELECT author_id, round(f, 6) + 0.0 AS fraction FROM fr",
    "collusion_two_windows": PRE + """, s2 AS (SELECT author_id, user_id, count(*) FILTER (ordinal % 2 = 0) AS a, count(*) FILTER (ordinal % 2 = 1) AS b FROM r WHERE val > 0 GROUP BY 1, 2),
        s3 AS (SELECT author_id, CAST(CASE WHEN a > 0 THEN a * 0.6 ELSE 0.0 END + b AS DOUBLE) AS s FROM s2),
        s4 AS (SELECT *, max(s) OVER (PARTITION BY author_id) AS top FROM s3)
        SELECT author_id, round(CASE WHEN max(s) >= 2 THEN coalesce(sum(s * s / top) FILTER (s >= 2), 0.0) / sum(s) ELSE 0.0 END, 6) + 0.0 AS fraction FROM s4 GROUP BY 1""",
    "penalised_blcb": PRE + _CO + _MF + " SELECT sc.post_id, round(b_lcb - 0.25 * coalesce(c, 0.0) - 0.5 * coalesce(f, 0.0), 6) + 0.0 AS b_lcb FROM sc LEFT JOIN co USING (post_id) LEFT JOIN fr ON fr.author_id = sc.author_id",
    "budget_replenish": PRE + ", " + _bud("") + " SELECT identity_id, round(least(greatest(10.0 + earned, 0.0), 100.0), 6) + 0.0 AS budget FROM b",
    "budget_share": PRE + ", " + _bud("") + """ SELECT identity_id, round(least(greatest(10.0 + count(*) OVER () * 10.0 * earned / sum(earned) OVER (), 0.0), 100.0), 6) + 0.0 AS budget FROM b""",
    "budget_memory_two_windows": PRE + ", " + _bud("WHERE ordinal % 2 = 0", name="b1") + ", " + _bud("WHERE ordinal % 2 = 1", name="b2")
    + """ SELECT identity_id, round(least(greatest(10.0 + 0.5 * (least(10.0 + b1.earned, 100.0) - 10.0) + b2.earned, 0.0), 100.0), 6) + 0.0 AS budget FROM b1 JOIN b2 USING (identity_id)""",
    "budget_streaming": PRE + """, cf AS (SELECT post_id, sum(n_cp) / (sum(n_cp) + 8.0) AS c FROM rec GROUP BY 1),
        ex AS (SELECT post_id, count(*) FILTER (ordinal % 2 = 0) AS a, count(*) AS n FROM exposures GROUP BY 1),
        cr AS (SELECT p.author_id, greatest(coalesce(b_lcb, 0.0), 0.0) * coalesce(c, 0.0) AS f, coalesce(a, 0) AS a, coalesce(n, 0) AS n FROM posts p LEFT JOIN sc USING (post_id) LEFT JOIN cf USING (post_id) LEFT JOIN ex USING (post_id))
        SELECT author_id AS identity_id, round(least(10.0 + sum(greatest(f * n - f * a, 0.0)), 100.0), 6) + 0.0 AS budget FROM cr GROUP BY 1""",
    "replicator_gain": PRE + " SELECT round(avg(greatest(coalesce(b_lcb, 0.0), 0.0)), 6) + 0.0 AS gain FROM posts LEFT JOIN sc USING (post_id)",
    "amplification_collar": PRE + """, co AS (SELECT sc.post_id, b_lcb, coalesce(n, 0) AS reach, 0.5 * tested AS cap FROM sc LEFT JOIN (SELECT post_id, count(*) AS n FROM exposures GROUP BY 1) e2 USING (post_id)
          JOIN (SELECT post_id, count(*) AS tested FROM r GROUP BY 1) t2 USING (post_id))
        SELECT post_id, round(CASE WHEN reach <= cap THEN 1.0 ELSE cap / reach END, 6) + 0.0 AS collar, round(b_lcb * CASE WHEN reach <= cap THEN 1.0 ELSE cap / reach END, 6) + 0.0 AS strength FROM co""",
    "audition_posterior": PRE + """, nr AS (SELECT post_id, (b_lcb - (SELECT min(b_lcb) FROM sc)) / (SELECT max(b_lcb) - min(b_lcb) FROM sc) AS w FROM sc WHERE post_id IN (SELECT post_id FROM exposures)),
        pb AS (SELECT post_id, 0.4 + w AS a, 3.6 + 1.0 - w AS b FROM nr)
        SELECT post_id, round(a, 6) + 0.0 AS alpha, round(b, 6) + 0.0 AS beta, a * b / ((a + b) * (a + b) * (a + b + 1.0)) <= 0.05 AS closed FROM pb""",
    "gini_lambda": _INF + " SELECT round(2.0 * sum(i * l) / (count(*) * sum(l)) - (count(*) + 1.0) / count(*), 6) + 0.0 AS gini FROM (SELECT l, row_number() OVER (ORDER BY l) AS i FROM inf)",
    "n_eff": _INF + " SELECT round(sum(l) * sum(l) / sum(l * l), 6) + 0.0 AS n_eff FROM inf",
    "saturation_depth": _DAYS + " SELECT author_id, round(CASE WHEN count(*) < 3 THEN 0.5 ELSE exp(-3.0 * greatest(-regr_slope(ln(greatest(v, 1e-3)), day), 0.0)) END, 6) + 0.0 AS prior FROM dy GROUP BY 1",
    "lipschitz": _DAYS + """, ch AS (SELECT author_id, abs(m - lag(m) OVER o) AS dm, abs(n - lag(n) OVER o) AS dn FROM dy WINDOW o AS (PARTITION BY author_id ORDER BY day))
        SELECT author_id, round(coalesce(median(CASE WHEN dn > 1e-9 THEN dm / dn END), 0.0), 6) + 0.0 AS lipschitz FROM ch GROUP BY 1""",
    "endogenous_shift": PRE + """ SELECT cluster, round(greatest(abs(avg(val) FILTER (source IS DISTINCT FROM 'exploration' AND ordinal % 2 = 0) - avg(val) FILTER (source IS DISTINCT FROM 'exploration' AND ordinal % 2 = 1))
        - abs(avg(val) FILTER (source = 'exploration' AND ordinal % 2 = 0) - avg(val) FILTER (source = 'exploration' AND ordinal % 2 = 1)), 0.0), 6) + 0.0 AS shift FROM x JOIN k USING (user_id) GROUP BY 1""",
    "portfolio_allocate": PRE + """, g AS (SELECT source AS arm, 0.3 * avg(val) AS g FROM x WHERE source IS NOT NULL GROUP BY 1)
        SELECT arm, round(0.1 + (1.0 - 0.1 * count(*) OVER ()) * exp(g / 0.1) / sum(exp(g / 0.1)) OVER (), 6) AS share FROM g""",
    "coreaction_edges": _GRAPH + " SELECT u, v, round(w, 6) + 0.0 AS w FROM gr WHERE w > 0",
    "morans_i_approvals": _GRAPH_R + """, zz AS (SELECT user_id, x - avg(x) OVER () AS z FROM k)
        SELECT round((SELECT count(*) FROM zz) * sum(w * a.z * b.z) / (sum(w) * (SELECT sum(z * z) FROM zz)), 6) + 0.0 AS morans_i, count(*) FILTER (w > 1e-9) AS edges FROM gr JOIN zz a ON a.user_id = u JOIN zz b ON b.user_id = v""",
    "morans_i": _GRAPH + """, vl AS (SELECT DISTINCT user_id, CAST(ascii(right(user_id, 1)) % 7 - 3 AS DOUBLE) AS y FROM v), zz AS (SELECT user_id, y - avg(y) OVER () AS z FROM vl)
        SELECT round((SELECT count(*) FROM zz) * sum(w * a.z * b.z) / (sum(w) * (SELECT sum(z * z) FROM zz)), 6) + 0.0 AS morans_i FROM gr JOIN zz a ON a.user_id = u JOIN zz b ON b.user_id = v""",
}
