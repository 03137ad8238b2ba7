"""Propensities of exposure and the estimators that weigh by them.

A propensity model is a function of a reaction joined to its exposure (columns slot, source, propensity, NULL
where there was none) that returns a Column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[[], Column]


def _positive(epsilon: float) -> float:
    if not epsilon > 0:
        raise ValueError("the propensity floor must be positive")
    return float(epsilon)


def uniform(epsilon: float) -> Column:
    return F.lit(_positive(epsilon))


def position_based(epsilon: float, base: float = 0.9, examination: Callable[[Column], Column] | None = None) -> Column:
    """By slot: base^slot (or a given examination curve), not below the floor; without exposure as in the first slot."""
    slot = F.greatest(F.coalesce(F.col("slot"), F.lit(0)), F.lit(0))
    seen = examination(slot) if examination else F.pow(F.lit(base), slot)
    return F.greatest(F.lit(_positive(epsilon)), seen)


def logged(epsilon: float) -> Column:
    """The logged propensity, not below the floor; the floor where none was logged."""
    floor = F.lit(_positive(epsilon))
    return F.greatest(floor, F.coalesce(F.nanvl(F.col("propensity"), floor), floor))


def policy_softmax(scores: DataFrame, epsilon: float, temperature: float = 1.0) -> DataFrame:
    """(user_id, post_id, pi): softmax of a viewer's candidate scores, not below the floor."""
    over = Window.partitionBy("user_id")
    x = F.col("score") / F.lit(temperature)
    e = F.exp(x - F.max(x).over(over))
    return scores.withColumn("__e", e).select(
        "user_id", "post_id", F.greatest(F.lit(_positive(epsilon)), F.col("__e") / F.sum("__e").over(over)).alias("pi")
    )


def with_exposure(reactions: DataFrame, exposures: DataFrame) -> DataFrame:
    """Reactions left joined to the exposure index (one row per user and post)."""
    return reactions.join(exposures.select("user_id", "post_id", "slot", "source", "propensity"), ["user_id", "post_id"], "left")


def inverse(pi: Column, w_max: float = 20.0) -> Column:
    return F.least(F.lit(1.0) / F.greatest(pi, F.lit(1e-12)), F.lit(float(w_max)))


def ipw_weights(
    exposed: DataFrame,
    pi: Column,
    w_max: float = 20.0,
    rater_lambda: DataFrame | None = None,
    delta: float = 0.85,
    reliability: Column | None = None,
) -> DataFrame:
    """exposed + weight: lambda * min(1/pi, w_max) * reliability, rescaled to mean 1.

    Raters without a lambda get (1 - delta) / rows. Weights that sum to 0 are not rescaled.
    """
    rows = exposed
    factor = inverse(pi, w_max)
    if reliability is not None:
        factor = factor * reliability
    if rater_lambda is None:
        rows = rows.withColumn("__raw", factor)
    else:
        size = exposed.agg(F.count(F.lit(1))).scalar()
        rows = rows.join(rater_lambda.select("user_id", F.col("lambda").alias("__lambda")), "user_id", "left")
        rows = rows.withColumn("__raw", factor * F.coalesce("__lambda", F.lit(1.0 - delta) / size)).drop("__lambda")
    mean = rows.agg(F.coalesce(F.avg("__raw"), F.lit(0.0)).alias("m")).scalar()
    return rows.withColumn("weight", F.when(mean > 0, F.col("__raw") / mean).otherwise(F.col("__raw"))).drop("__raw")


def snipw(rows: DataFrame, by: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Self-normalised weighted mean; NULL where the weights do not sum to more than 0."""
    total = F.sum(weight)
    return rows.groupBy(*by).agg(F.when(total > 0, F.try_divide(F.sum(F.col(weight) * F.col(value)), total)).alias("estimate"))


def doubly_robust(pairs: DataFrame, by: list[str], w_max: float = 20.0) -> DataFrame:
    """Mean of imputed values, each corrected where a value was observed.

    pairs: *by, imputed, value (NULL where unobserved), pi. The inverse propensity is clipped to w_max.
    """
    return pairs.groupBy(*by).agg(F.avg(F.col("imputed") + F.coalesce(inverse(F.col("pi"), w_max) * (F.col("value") - F.col("imputed")), F.lit(0.0))).alias("estimate"))
