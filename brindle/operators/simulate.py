"""Synthetic worlds: populations, posts, reactions, welfare, biased logs, and a closed loop over windows.

Draws are fixed by the ids and a seed, not by the order of rows, so a world is the same however it is partitioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.operators.factorization import hashed_normal
from brindle.operators.metrics import churn
from brindle.operators.rater import dot
from brindle.session import cut


def uniform(*key: Column | str, seed: int = 0) -> Column:
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def normal(*key: Column | str, seed: int = 0) -> Column:
    return F.sqrt(-2.0 * F.log(uniform(*key, seed=seed * 2 + 1))) * F.cos(F.lit(2 * math.pi) * uniform(*key, seed=seed * 2 + 2))


# Fixed values of the synthetic world.
#: Reactions: how toxicity draws them and widens the divide, what quality adds, scale of alignment, reactions to nothing special.
DRAW_OF_TOXICITY, DIVIDE_BY_TOXICITY, BONUS_OF_QUALITY, ALIGNMENT, BASE_REACTION = 1.2, 1.5, 0.4, 0.6, 0.35
#: Vouches: noise of a reader's view of quality, and where it is vouched for and against.
VIEW_NOISE, VOUCH_ABOVE, VOUCH_BELOW = 0.15, 0.55, 0.45
#: Authors: archetype, lean on the first axis, spread of their posts, response to reach, least and most posts, toxicity, quality.
CAST = (
    ("universal", 0.0, 0.15, 0.5, 1, 4, 0.05, 0.85),
    ("partisan_right", 2.0, 0.2, 0.5, 1, 4, 0.2, 0.6),
    ("partisan_left", -2.0, 0.2, 0.5, 1, 4, 0.2, 0.6),
    ("firehose", 0.0, 1.5, 3.0, 3, 8, 0.3, 0.35),
    ("toxic_partisan", 1.6, 0.25, 0.5, 1, 5, 0.9, 0.4),
    ("bridging_bait", 0.0, 0.15, 0.5, 1, 5, 0.05, 0.1),
)


def population(spark: SparkSession, n: int, d: int = 3, gap: float = 2.0, spread: float = 0.5, indiscriminate: float = 0.2, seed: int = 0) -> DataFrame:
    """(user_id, pole, opinion ARRAY, reactivity, selectivity): two camps on the first axis, noise on all axes.

    A share of readers is indiscriminate: what they think of a post hardly shows in their reactions.
    """
    rows = spark.range(n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id"), (F.col("id") % 2).cast("int").alias("pole"))
    noise = hashed_normal(F.col("user_id"), d, spread, seed)
    side = F.when(F.col("pole") == 0, -gap).otherwise(gap)
    keen = F.when(uniform("user_id", seed=seed + 51) < indiscriminate, 0.3).otherwise(1.0 + uniform("user_id", seed=seed + 52))
    return rows.select(
        "user_id", "pole", F.transform(noise, lambda x, i: x + F.when(i == 0, side).otherwise(0.0)).alias("opinion"),
        (0.7 + 0.6 * uniform("user_id", seed=seed + 53)).alias("reactivity"), keen.alias("selectivity"),
    )


@dataclass
class Author:
    """An author's present style and reach, and the search for more of it: a trial style is kept only if reach did not fall."""

    author_id: str
    archetype: str
    style: np.ndarray
    spread: float
    response: float
    least: int
    most: int
    toxicity: float
    quality: float
    reach: float = 1.0  # per post, in the last window
    kept: np.ndarray | None = None
    best: float = -1.0

    def volume(self) -> int:
        """More posts while each is read, never more than `most`."""
        return int(min(self.most, max(1, round(self.least + self.response * self.reach))))

    def trial(self, step: float, rng: np.random.Generator) -> None:
        if step > 0:
            self.kept = self.style.copy() if self.kept is None else self.kept
            self.style = self.kept + rng.normal(0.0, step, len(self.style))

    def judge(self, reach: float) -> None:
        self.reach = reach
        if self.kept is None:
            return
        if reach >= self.best:
            self.kept, self.best = self.style.copy(), reach
        else:
            self.style = self.kept.copy()


def cast(n: int = 6, d: int = 3) -> list[Author]:
    out = []
    for i in range(n):
        name, lean, *rest = CAST[i % len(CAST)]
        out.append(Author(f"a{i}", name, np.r_[lean, np.zeros(d - 1)], *rest))
    return out


def authors(spark: SparkSession, n: int = 6, d: int = 3, of: list[Author] | None = None) -> DataFrame:
    """(author_id, archetype, style ARRAY, spread, volume, toxicity, quality)."""
    rows = [(a.author_id, a.archetype, [float(x) for x in a.style], a.spread, a.volume(), a.toxicity, a.quality) for a in of or cast(n, d)]
    return spark.createDataFrame(rows, "author_id string, archetype string, style array<double>, spread double, volume int, toxicity double, quality double")


def posts_of(authors_: DataFrame, window: int, d: int = 3, seed: int = 0) -> DataFrame:
    """(post_id, author_id, created_at, loading ARRAY, quality, toxicity, depth): the truth of a window's posts.

    depth is what a reader could see of the quality.
    """
    rows = authors_.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("volume") - 1)))
    rows = rows.withColumn("post_id", F.concat_ws("-", "author_id", F.lit(str(window)), F.col("k").cast("string")))
    loading = F.zip_with("style", hashed_normal(F.col("post_id"), d, 1.0, seed), lambda s, x: s + x * F.col("spread"))

    def near(x: Column, sd: float, salt: int) -> Column:
        return F.least(F.greatest(x + F.lit(sd) * normal("post_id", seed=seed + salt), F.lit(0.0)), F.lit(1.0))

    out = rows.select("post_id", "author_id", (F.lit(float(window)) + F.col("k") / 100.0).alias("created_at"), loading.alias("loading"),
                      near(F.col("quality"), 0.15, 61).alias("quality"), near(F.col("toxicity"), 0.1, 62).alias("toxicity"))
    return out.withColumn("depth", near(F.col("quality"), 0.2, 63))


def _aligned() -> Column:
    return F.lit(ALIGNMENT) * dot(F.col("opinion"), F.col("loading"))


def approval() -> Column:
    """Probability that a reader who reacts approves: alignment, sharpened by selectivity and toxicity, and a little quality."""
    logit = F.col("selectivity") * _aligned() * (1.0 + F.lit(DIVIDE_BY_TOXICITY) * F.col("toxicity")) + F.lit(BONUS_OF_QUALITY) * (F.col("quality") - 0.5)
    return 1.0 / (1.0 + F.exp(-logit))


def reaction_pull() -> Column:
    """Probability that a reader reacts at all: toxicity above all."""
    pull = F.col("reactivity") * (F.lit(BASE_REACTION) + F.lit(DRAW_OF_TOXICITY) * F.col("toxicity") + 0.1 * F.abs(_aligned()))
    return F.least(F.greatest(pull, F.lit(0.0)), F.lit(1.0))


def react(shown: DataFrame, seed: int = 0) -> DataFrame:
    """Reactions (user_id, post_id, value, kind) to shown posts with their truth; no reaction is a weak one against."""
    acts, likes, p = uniform("user_id", "post_id", seed=seed + 11) < reaction_pull(), uniform("user_id", "post_id", seed=seed + 12) < F.col("__p"), F.col("__p")
    kind = F.when(acts & likes & (p > 0.7), "boost").when(acts & likes, "favorite").when(acts & (p < 0.3), "mute").otherwise("exposed_no_reaction")
    value = F.when(kind == "boost", 1.0).when(kind == "favorite", 0.5).when(kind == "mute", -1.0).otherwise(-0.1)
    return shown.withColumn("__p", approval()).select("user_id", "post_id", value.alias("value"), kind.alias("kind"))


def vouch(shown: DataFrame, seed: int = 0) -> DataFrame:
    """Vouches for and against by each reader's view of the quality, whatever the opinion; unclear ones give none."""
    view = F.col("quality") + F.lit(VIEW_NOISE) * normal("user_id", "post_id", seed=seed + 21)
    value = F.when(view > VOUCH_ABOVE, 1.0).when(view < VOUCH_BELOW, -1.0)
    return shown.select("user_id", "post_id", value.alias("value"), F.lit("vouch").alias("kind")).filter(F.col("value").isNotNull())


def welfare(shown: DataFrame) -> DataFrame:
    """(post_id, bridged, divisiveness, true_value) over the audience of each post, by camp: worst mean approval, the
    gap between the camps, and the worst approval weighted by quality."""
    camps = shown.withColumn("__p", approval()).groupBy("post_id", "pole").agg(F.avg("__p").alias("m"), F.first("quality").alias("quality"))
    return camps.groupBy("post_id").agg(
        F.min("m").alias("bridged"), (F.max("m") - F.min("m")).alias("divisiveness"), (F.min("m") * F.first("quality")).alias("true_value")
    )


# ---------------------------------------------------------------------------------------------
# biased logs


def mnar_world(spark: SparkSession, n_users: int = 60, n_posts: int = 40, universal: float = 0.3, noise: float = 0.15, seed: int = 0) -> DataFrame:
    """(user_id, post_id, value, align, intercept, universal): the full matrix of a world of two camps.

    A share of the posts is universal: near the origin and well received; the others belong to a camp. The value of a
    pair is the post's intercept and the alignment of the two, with noise, within [-1, 1].
    """
    users = population(spark, n_users, 2, 1.5, 0.3, seed=seed).select("user_id", "opinion")
    good = F.col("id") < int(universal * n_posts)
    posts = spark.range(n_posts).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("post_id"), good.alias("universal"))
    wide = F.when(F.col("universal"), 0.1).otherwise(0.15)
    first = F.when(F.col("universal"), 0.1 * normal("post_id", seed=seed + 1)).otherwise((1.0 + 0.6 * uniform("post_id", seed=seed + 2)) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0))
    level = uniform("post_id", seed=seed + 3)
    posts = posts.select("post_id", "universal", F.array(first, wide * normal("post_id", seed=seed + 4)).alias("loading"), F.when(F.col("universal"), 0.3 + 0.3 * level).otherwise(0.2 * level - 0.1).alias("intercept"))
    pairs = users.crossJoin(posts)  # the world itself: every pair has a truth, of which few are shown
    align = dot(F.col("opinion"), F.col("loading"))
    value = F.col("intercept") + align + F.lit(noise) * normal("user_id", "post_id", seed=seed + 5)
    return pairs.select("user_id", "post_id", F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)).alias("value"), align.alias("align"), "intercept", "universal")


def biased_log(world: DataFrame, epsilon: float = 0.05, rate: float = 0.3, bias: float = 4.0, seed: int = 0) -> DataFrame:
    """world's pairs that were shown + propensity, source: aligned pairs are shown more often, on average `rate` of all,
    and a share epsilon at random, with a known propensity."""
    organic = 1.0 / (1.0 + F.exp(-F.lit(bias) * F.col("align")))
    scaled = F.least(organic * F.lit(rate) / world.agg(F.avg(organic).alias("m")).scalar(), F.lit(0.98))
    explored = uniform("user_id", "post_id", seed=seed + 71) < epsilon
    source = F.when(explored, "exploration").when(uniform("user_id", "post_id", seed=seed + 72) < F.col("__pi"), "organic")
    rows = world.withColumn("__pi", scaled).withColumn("source", source).filter(F.col("source").isNotNull())
    return rows.withColumn("propensity", F.when(F.col("source") == "exploration", F.lit(float(epsilon))).otherwise(F.col("__pi"))).drop("__pi")


def mnar_experiment(spark: SparkSession, n_users: int = 60, n_posts: int = 40, epsilon: float = 0.05, sweeps: int = 40, seed: int = 0) -> DataFrame:
    """(corrected, ranking, partisan_bias, partisan_norm): a factorization of a biased log with and without inverse
    propensities: rank correlation of the posts' biases with their intercepts, and bias and length of the camps' posts."""
    from brindle.operators.factorization import fit
    from brindle.operators.metrics import spearman
    from brindle.operators.propensity import ipw_weights, logged

    world = cut(mnar_world(spark, n_users, n_posts, seed=seed))
    log = cut(biased_log(world, epsilon, seed=seed).withColumn("author_id", F.concat(F.lit("of "), "post_id")))
    truth = world.select("post_id", "intercept", "universal").distinct()
    s, out = Settings(d=2, mf_iterations=sweeps, reg_post=0.05, local_rows=1_000_000), None
    for corrected, rows in ((False, log.withColumn("weight", F.lit(1.0))), (True, ipw_weights(log, logged(1e-6), s.w_max))):
        model = fit(rows, s, seed, local_rows=s.local_rows)
        got = cut(truth.join(model.posts, "post_id", "left").select("universal", F.round(F.coalesce("b_p", F.lit(0.0)), 9).alias("b"), F.round("intercept", 9).alias("intercept"), F.sqrt(F.coalesce(dot(F.col("y"), F.col("y")), F.lit(0.0))).alias("norm")))
        ranking = spearman(got, "b", "intercept").first()[0]
        bias, norm = got.filter(~F.col("universal")).agg(F.avg("b"), F.avg("norm")).first()
        row = spark.createDataFrame([(corrected, ranking, bias, norm)], "corrected boolean, ranking double, partisan_bias double, partisan_norm double")
        out = row if out is None else out.unionByName(row)
    return out


def induce_mnar(reactions: DataFrame, epsilon: float = 0.1, strength: float = 2.0, seed: int = 0) -> DataFrame:
    """reactions + split (`test`, `anchor`, `train`), propensity: a log thinned towards high values, with an unbiased
    anchor slice of share epsilon and a held-out fifth; rows not drawn are left out."""
    pi = F.lit(epsilon) + F.lit(1.0 - epsilon) / (1.0 + F.exp(-F.lit(strength) * F.col("value")))

    def draw(salt: int) -> Column:
        """By md5, which other engines have too: 52 bits."""
        return F.conv(F.substring(F.md5(F.concat_ws("|", "user_id", "post_id", F.lit(str(seed + salt)))), 1, 13), 16, 10).cast("double") / float(1 << 52)

    u, v = draw(31), draw(32)
    split = F.when(u < 0.2, "test").when(v < epsilon, "anchor").when(v < pi, "train")
    return reactions.withColumn("propensity", pi).withColumn("split", split).filter(F.col("split").isNotNull())


def polarity_axis(reactions: DataFrame, rounds: int = 30) -> DataFrame:
    """(user_id, polarity): leading left singular vector of the user by item matrix of mean values, where what is missing
    stands at its item's mean and users' and items' means are taken off; the filled matrix is never made."""
    from brindle.operators.geometry import centred_cells, singular_coordinates

    points, _ = singular_coordinates(centred_cells(reactions), 1, rounds=rounds, centre=True)
    return points.select("user_id", F.col("c0").alias("polarity"))


# ---------------------------------------------------------------------------------------------
# the closed loop


@dataclass
class Result:
    windows: list[dict] = field(default_factory=list)

    def series(self, name: str) -> list[float]:
        return [w[name] for w in self.windows]

    def tail(self, name: str, k: int = 3) -> float:
        xs = [x for x in self.series(name)[-k:] if x is not None]
        return float(np.mean(xs)) if xs else float("nan")

    def is_stable(self, name: str, tolerance: float = 0.05, k: int = 3) -> bool:
        xs = self.series(name)[-k:]
        return len(xs) == k and max(xs) - min(xs) <= tolerance


@dataclass(frozen=True)
class World:
    users: int = 40
    authors: int = 6
    slots: int = 6
    windows: int = 4
    epsilon: float = 0.1
    performativity: float = 0.0  # how hard authors change their style in search of reach
    seed: int = 0
    live_windows: int = 3  # windows for which a post stays a candidate
    ring: int = 0  # puppets who boost the posts of one author
    ring_target: str = "a3"
    camouflage: int = 0  # genuine posts a puppet rates like a member of a camp
    forged_vouches: bool = False


def explored(candidates: DataFrame, feed: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(user_id, post_id): an exploration slice outside the feed; the expected size is share x the feed's, the rest of a
    slot drawn at random."""
    want = feed.groupBy("user_id").agg((F.count(F.lit(1)) * F.lit(share)).alias("__w"))
    size = F.floor("__w") + F.when(uniform("user_id", seed=seed + 41) < F.col("__w") - F.floor("__w"), 1).otherwise(0)
    rest = candidates.select("user_id", "post_id").join(feed.select("user_id", "post_id"), ["user_id", "post_id"], "left_anti").join(want.select("user_id", size.alias("__n")), "user_id")
    order = Window.partitionBy("user_id").orderBy(F.xxhash64("user_id", "post_id", F.lit(seed + 42)), "post_id")
    return rest.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= F.col("__n")).select("user_id", "post_id")


def ring_attack(spark: SparkSession, posts: DataFrame, w: World, window: int) -> tuple[DataFrame, DataFrame]:
    """(reactions, exposures) of a ring of puppets: boosts of the target's posts, which nobody served them (out of band),
    and genuine-looking ratings of other posts as camouflage."""
    puppets = population(spark, w.ring, seed=w.seed + 99).select(F.concat(F.lit("z"), "user_id").alias("user_id"), "pole", "opinion", "reactivity", "selectivity")
    pairs = puppets.crossJoin(posts.select("post_id", "author_id", "loading", "quality", "toxicity"))  # a ring of given size on few posts
    boosts = pairs.filter(F.col("author_id") == w.ring_target).select("user_id", "post_id", F.lit(1.0).alias("value"), F.lit("boost").alias("kind"))
    rows = boosts
    if w.forged_vouches:
        rows = rows.unionByName(boosts.withColumn("kind", F.lit("vouch")))
    shown = boosts.select("user_id", "post_id", F.lit("out_of_band").alias("source"))
    if w.camouflage:
        order = Window.partitionBy("user_id").orderBy(F.xxhash64("user_id", "post_id", F.lit(window)), "post_id")
        hidden = pairs.filter(F.col("author_id") != w.ring_target).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= w.camouflage)
        rows = rows.unionByName(react(hidden, seed=w.seed + window))
        shown = shown.unionByName(hidden.select("user_id", "post_id", F.lit("organic").alias("source")))
    return rows, shown


def run(spark: SparkSession, ranker, world: World = World()) -> Result:
    """Windows of: publish, rank for every agent, react, observe, adapt.

    ranker: object with rank(candidates, posts) -> (user_id, slot, post_id) and observe(reactions, posts, exposures).
    """
    people = cut(population(spark, world.users, seed=world.seed))
    writers, out = cast(world.authors), Result()
    rng = np.random.default_rng(world.seed)
    before, alive = None, []
    for t in range(world.windows):
        for a in writers:
            a.trial(1.2 * world.performativity, rng)
        fresh = cut(posts_of(authors(spark, of=writers), t, seed=world.seed))
        alive = [fresh, *alive][: world.live_windows]
        posts = reduce(DataFrame.unionByName, alive)
        audience = people.crossJoin(posts)  # every agent may see each of the few live posts
        candidates = audience.select("user_id", "post_id", "author_id", "created_at")
        feed = cut(ranker.rank(candidates, posts).select("user_id", "slot", "post_id"))
        extra = explored(candidates, feed, world.epsilon, world.seed + t)
        shown = feed.select("user_id", "post_id", F.lit("organic").alias("source")).unionByName(extra.withColumn("source", F.lit("exploration")))
        truth = cut(shown.join(people, "user_id").join(posts, "post_id").hint("rebalance"))
        reactions = react(truth, seed=world.seed + t).unionByName(vouch(truth, seed=world.seed + t))
        exposures = truth.select("user_id", "post_id", "source")
        if world.ring:
            boosts, told = ring_attack(spark, fresh, world, t)
            reactions, exposures = reactions.unionByName(boosts), exposures.unionByName(told)
        reactions, exposures = cut(reactions.hint("rebalance")), cut(exposures.hint("rebalance"))
        value = welfare(audience).join(truth.select("post_id"), "post_id").agg(F.avg("true_value"), F.avg("divisiveness")).first()
        n, toxicity, satisfied, target = truth.agg(
            F.count(F.lit(1)), F.avg("toxicity"), F.avg(approval()), F.sum(F.when(F.col("author_id") == world.ring_target, 1).otherwise(0))
        ).first()
        moved = None
        if before is not None:
            two = feed.select("user_id", "post_id", F.lit(1).alias("window")).unionByName(before.select("user_id", "post_id", F.lit(0).alias("window")))
            moved = churn(two).agg(F.avg("churn")).first()[0]
        out.windows.append({"window": t, "impressions": n, "true_value": value[0], "divisiveness": value[1], "toxicity": toxicity, "satisfaction": satisfied, "churn": moved, "target_reach": target})
        ranker.observe(reactions, posts, exposures)
        reach = {r["author_id"]: float(r["n"]) for r in truth.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = {r["author_id"]: r["n"] for r in fresh.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        out.windows[-1]["reach"] = {a.archetype: reach.get(a.author_id, 0.0) / max(1, sizes.get(a.author_id, 1)) for a in writers}
        for a in writers:
            a.judge(reach.get(a.author_id, 0.0) / max(1, sizes.get(a.author_id, 1)))
        before = feed
    return out


def compare(spark: SparkSession, rankers: dict, world: World = World()) -> dict[str, Result]:
    """The same world under several rankers."""
    return {name: run(spark, ranker, world) for name, ranker in rankers.items()}


class ChronologicalRanker:
    """Newest first."""

    def __init__(self, slots: int = 6):
        self.slots = slots

    def rank(self, candidates: DataFrame, posts: DataFrame) -> DataFrame:
        from brindle.operators.feed import chronological

        return chronological(candidates, self.slots)

    def observe(self, reactions: DataFrame, posts: DataFrame, exposures: DataFrame) -> None:
        return None


class BridgingRanker(ChronologicalRanker):
    """The whole engine in the loop: fits every window, ranks by bridged value, auditions what it hasn't seen."""

    def __init__(self, engine, slots: int = 6):
        super().__init__(slots)
        # a synthetic world is of a few thousand rows by construction
        engine.settings = replace(engine.settings, local_rows=1_000_000)
        self.engine = engine

    def rank(self, candidates: DataFrame, posts: DataFrame) -> DataFrame:
        if self.engine.fitted is None:
            return super().rank(candidates, posts)
        order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "post_id"))
        return self.engine.rank(candidates.select("user_id", order.alias("pos"), "post_id"), slots=self.slots, posts=posts)

    def observe(self, reactions: DataFrame, posts: DataFrame, exposures: DataFrame) -> None:
        rows = reactions.select(F.xxhash64("user_id", "post_id", "kind").alias("ordinal"), "user_id", "post_id", "value", "kind", F.lit(0.0).alias("ts"))
        pi = F.when(F.col("source") == "exploration", self.engine.settings.epsilon_min).otherwise(0.5)
        shown = exposures.select(F.xxhash64("user_id", "post_id").alias("ordinal"), "user_id", "post_id", F.lit(0.0).alias("timestamp"), F.lit(0).alias("slot"), "source", pi.alias("propensity"))
        self.engine.fit_window(rows, posts.select("post_id", "author_id"), shown)


class RandomRanker(ChronologicalRanker):
    def rank(self, candidates: DataFrame, posts: DataFrame) -> DataFrame:
        from brindle.operators.feed import shuffled

        return shuffled(candidates, self.slots)


class OracleRanker(ChronologicalRanker):
    """Knows the truth: the posts of the greatest true value to the population, given as `people`."""

    def __init__(self, slots: int = 6, people: DataFrame | None = None):
        super().__init__(slots)
        self.people = people

    def rank(self, candidates: DataFrame, posts: DataFrame) -> DataFrame:
        from brindle.operators.feed import by_score

        if self.people is None:
            return by_score(candidates.join(posts.select("post_id", "quality"), "post_id"), F.col("quality"), self.slots)
        value = welfare(self.people.crossJoin(posts)).select("post_id", "true_value")  # every agent's truth of the few live posts
        return by_score(candidates.join(value, "post_id"), F.col("true_value"), self.slots)


class EngagementRanker(ChronologicalRanker):
    """By the value a factorization of past reactions predicts; authors stand in for their new posts."""

    def __init__(self, slots: int = 6, s: Settings = Settings(d=2, mf_iterations=3)):
        super().__init__(slots)
        self.s, self.model = s, None

    def rank(self, candidates: DataFrame, posts: DataFrame) -> DataFrame:
        from brindle.operators.feed import by_score

        if self.model is None:
            return super().rank(candidates, posts)
        rows = candidates.withColumn("__post", F.col("post_id")).withColumn("post_id", F.col("author_id"))
        scored = self.model.predict(rows).select("user_id", F.col("__post").alias("post_id"), "predicted")
        return by_score(scored, F.col("predicted"), self.slots)

    def observe(self, reactions: DataFrame, posts: DataFrame, exposures: DataFrame) -> None:
        from brindle.operators.factorization import fit

        seen = reactions.filter("kind <> 'vouch'").join(posts.select("post_id", "author_id"), "post_id")
        if seen.limit(1).count():
            self.model = fit(seen.select("user_id", F.col("author_id").alias("post_id"), "author_id", "value", F.lit(1.0).alias("weight")), self.s, local_rows=1_000_000)
