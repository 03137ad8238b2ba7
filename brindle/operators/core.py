"""The core tables: signed reactions by channel, the exposure index, identities, viewers' knobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import SIGNED_VALUES, Knobs


def signed_value(kind: Column, exposure_penalty: float = 0.1) -> Column:
    """Signed value of a kind of reaction; vouches carry their own value and unknown kinds none."""
    out = F.lit(None).cast("double")
    for name, v in SIGNED_VALUES.items():
        out = F.when(kind == name, F.lit(-abs(exposure_penalty) if name == "exposed_no_reaction" else v)).otherwise(out)
    return out


def signals(reactions: DataFrame, exposure_penalty: float = 0.1) -> DataFrame:
    """Reactions with a usable value: as given, or from the kind where it is null or NaN; others are left out."""
    given = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
    kept = reactions.withColumn("value", F.coalesce(given, signed_value(F.col("kind"), exposure_penalty)))
    return kept.filter(F.col("value").isNotNull() & F.col("user_id").isNotNull() & F.col("post_id").isNotNull())


def channel(reactions: DataFrame, vouch: bool) -> DataFrame:
    """The vouch channel, or the approval channel (which has the null kinds)."""
    is_vouch = F.col("kind").eqNullSafe(F.lit("vouch"))
    return reactions.filter(is_vouch if vouch else ~is_vouch)


def with_author(reactions: DataFrame, posts: DataFrame) -> DataFrame:
    """Reactions to known posts, with the post's author."""
    return reactions.join(posts.select("post_id", "author_id"), "post_id")


def last_exposures(exposures: DataFrame) -> DataFrame:
    """One exposure per (user, post): that of the highest ordinal. A maximum, so hot pairs fold before the shuffle."""
    row = F.struct("ordinal", "timestamp", "slot", "source", "propensity")
    return exposures.groupBy("user_id", "post_id").agg(F.max(row).alias("__e")).select("user_id", "post_id", "__e.*")


def raters(reactions: DataFrame) -> DataFrame:
    return reactions.select("user_id").distinct()


def resolve(rows: DataFrame, account: str, aliases: DataFrame | None, to: str = "identity_id") -> DataFrame:
    """rows + the identity of an account: by alias (account_id, identity_id), else the account itself."""
    if aliases is None:
        return rows.withColumn(to, F.col(account))
    one = aliases.groupBy(F.col("account_id").alias("__account")).agg(F.min("identity_id").alias("__identity"))
    return (
        rows.join(one, F.col(account) == F.col("__account"), "left")
        .withColumn(to, F.coalesce("__identity", account))
        .drop("__account", "__identity")
    )


def forge_cost(age: Column) -> Column:
    """Cost of forging an identity of an age in days; unknown and future ages cost nothing."""
    return F.log1p(F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)))


def first_seen(events: DataFrame, account: str, at: str) -> DataFrame:
    return events.groupBy(F.col(account).alias("account_id")).agg(F.min(at).alias("first_seen"))


def knobs_of(viewers: DataFrame, knobs: DataFrame | None, default: Knobs = Knobs()) -> DataFrame:
    """viewers + M, rho, theta, epsilon, with the default where none are set; weights sum to 1."""
    literal = F.create_map(*[x for k, v in default.normalised_theta().items() for x in (F.lit(k), F.lit(float(v)))])
    if knobs is None:
        out = viewers.select("user_id", F.lit(default.M).alias("M"), F.lit(default.rho).alias("rho"), literal.alias("theta"), F.lit(default.epsilon).alias("epsilon"))
    else:
        joined = viewers.select("user_id").join(knobs.dropDuplicates(["user_id"]), "user_id", "left")
        total = F.aggregate(F.map_values("theta"), F.lit(0.0), lambda a, b: a + b)
        theta = F.when(total > 0, F.transform_values("theta", lambda _, v: v / total)).otherwise(literal)
        out = joined.select(
            "user_id",
            F.coalesce("M", F.lit(default.M)).alias("M"),
            F.coalesce("rho", F.lit(default.rho)).alias("rho"),
            theta.alias("theta"),
            F.coalesce("epsilon", F.lit(default.epsilon)).alias("epsilon"),
        )
    return out


def valid_knobs(knobs: DataFrame) -> DataFrame:
    """Fails the write of settings out of range, row by row and without a scan of its own."""
    bad = ~(F.col("M").between(0, 1) & F.col("rho").between(0, 1) & F.col("epsilon").between(0, 1))
    bad = bad | F.exists(F.map_values("theta"), lambda v: v < 0)
    return knobs.withColumn("M", F.when(bad, F.raise_error(F.lit("knobs out of range"))).otherwise(F.col("M")))


def timeline(own: DataFrame, shared: DataFrame, user_id: str) -> DataFrame:
    """A viewer's candidates: the own timeline and the shared one, as given (not deduplicated)."""
    return own.filter(F.col("user_id") == user_id).select("post_id").unionAll(shared.select("post_id"))


def rank_within(rows: DataFrame, keys: list[str], *order: Column, to: str = "rank") -> DataFrame:
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def literal_map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])
