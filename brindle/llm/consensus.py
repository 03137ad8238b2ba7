"""Consensus from several annotators who disagree: labels, agreement per item, reliability per annotator.

Spectral reliability: votes are centred by chance (the share of each label among all votes), and the
annotators' weights are the leading eigenvector of their mean centred agreement, each row corrected for the
number of votes the annotator shares with the others. It is found by power iteration through sparse joins
annotator -> item -> annotator; the annotator-by-annotator matrix is never formed. The weights weight the votes: the
first consensus is the weighted sum of the centred votes; from it follows what a vote for a label is worth at each
degree of reliability (one table for all annotators of about the same weight, so that the reliably wrong count
against their own label), and the label of an item is the one with the greatest sum over its votes.

Defined cases: an annotator's name is read without letter case and surrounding blanks; of several votes of an
annotator on an item the newest valid one counts, at equal time the greater value; null, NaN and other values
are no votes; null items, annotators or times: the vote is left out if item or annotator is null, an unknown time is
the oldest; ties between labels go to the greater label; empty input gives empty results; extra columns are
ignored. Weights shrink towards 0 for annotators with few shared votes; a warning is given where the iteration ends
before the weights have settled.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut


@dataclass(frozen=True)
class Spectral:
    labels: tuple[int, ...] = (-1, 0, 1)
    iterations: int = 30  # most rounds of the power iteration
    tolerance: float = 1e-5  # it ends when the cosine of successive weights is within this of 1
    shrink: float = 5.0  # votes added to an annotator's count, as of no agreement
    steps: int = 8  # degrees of reliability in a unit of weight (the mean absolute weight), from -1 to 2
    rounds: int = 2  # estimations of what votes are worth
    least_raters: int = 5

    @property
    def degrees(self) -> int:
        return 3 * self.steps


def newest_votes(ratings: DataFrame, item: str, annotator: str, value: str, time: str, labels: tuple[int, ...]) -> DataFrame:
    """(item, rater, label): one vote per item and annotator."""
    v = F.col(value).cast("double")
    newest = F.max(F.struct(F.coalesce(F.col(time).cast("double"), F.lit(float("-inf"))).alias("t"), v.alias("v")))
    return (
        ratings.select(F.col(item).alias("item"), F.lower(F.trim(F.col(annotator))).alias("rater"), F.col(value).alias(value), F.col(time).alias(time))
        .filter(v.isin(*[float(x) for x in labels]) & F.col("item").isNotNull() & F.col("rater").isNotNull())
        .groupBy("item", "rater")
        .agg(newest.alias("__newest"))
        .select("item", "rater", F.col("__newest.v").cast("int").alias("label"))
    )


def _shares(votes: DataFrame, labels: tuple[int, ...]) -> list[float]:
    """Share of each label among all votes."""
    counts = {r["label"]: r["n"] for r in votes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) or 1
    return [counts.get(x, 0) / total for x in labels]


def _of_label(labels: tuple[int, ...], values: list[Column]) -> Column:
    """The value that belongs to a row's label."""
    out = values[-1]
    for x, v in list(zip(labels, values))[:-1]:
        out = F.when(F.col("label") == x, v).otherwise(out)
    return out


def reliability(votes: DataFrame, how: Spectral) -> DataFrame:
    """(rater, weight, n): entries of the leading eigenvector, scaled to a mean absolute weight of 1.

    A round is a product with the votes' matrix and one with its transpose: an item collects the weights behind each
    label, an annotator the centred agreement with them, less its own part.
    """
    p = _shares(votes, how.labels)
    K, norm = len(p), sum(x * x for x in p)
    # squared length of a centred vote: the annotator's agreement with itself
    own = _of_label(how.labels, [F.lit(1.0 - 2.0 * x + norm) for x in p])
    weights = cut(votes.groupBy("rater").agg(F.lit(1.0).alias("weight"), F.count(F.lit(1)).alias("n"), F.sum(own).alias("own")))
    scale = 1.0
    for _ in range(how.iterations):
        given = weights.select("rater", (F.col("weight") * F.lit(scale)).alias("weight"), "n", "own")
        behind = votes.join(given.select("rater", "weight"), "rater").groupBy("item").agg(
            *[F.sum(F.when(F.col("label") == x, F.col("weight")).otherwise(0.0)).alias(f"s{k}") for k, x in enumerate(how.labels)],
            F.sum(F.abs("weight")).alias("mass"),
        )
        everything = sum((F.col(f"s{k}") for k in range(1, K)), F.col("s0"))
        centred = [F.col(f"s{k}") - F.lit(p[k]) * everything for k in range(K)]
        chance = sum((F.lit(p[k]) * centred[k] for k in range(1, K)), F.lit(p[0]) * centred[0])
        behind = behind.select("item", *[(c - chance).alias(f"v{k}") for k, c in enumerate(centred)], "mass")
        met = votes.join(behind, "item").groupBy("rater").agg(
            F.sum(_of_label(how.labels, [F.col(f"v{k}") for k in range(K)])).alias("a"), F.sum("mass").alias("b")
        )
        w, n = F.col("weight"), F.col("n")
        agreed = F.try_divide(F.col("a") - w * F.col("own"), F.when(F.col("b") - n * F.abs(w) > 1e-9, F.col("b") - n * F.abs(w)))
        raw = F.coalesce(agreed, F.lit(0.0)) * n / (n + F.lit(how.shrink))
        weights = cut(given.join(met, "rater").select("rater", raw.alias("weight"), "n", "own", w.alias("before")))
        new, old = F.col("weight"), F.col("before")
        mean, signed, both, ours, theirs = weights.agg(F.avg(F.abs(new)), F.sum(new * F.sqrt("n")), F.sum(new * old), F.sum(new * new), F.sum(old * old)).first()
        scale = (1.0 / mean if mean else 0.0) * (-1.0 if (signed or 0) < 0 else 1.0)
        if not mean or 1.0 - abs(both) / math.sqrt(ours * theirs) < how.tolerance:
            break
    else:
        warnings.warn(f"annotators' weights still moved after {how.iterations} rounds", stacklevel=2)
    return weights.select("rater", (F.col("weight") * F.lit(scale)).alias("weight"), "n")


def _best(scores: list[Column], labels: tuple[int, ...]) -> Column:
    """The label of the greatest score, of equal ones the greatest label."""
    best, out = F.greatest(*scores), None
    for x, s in zip(labels, scores):
        out = F.when(s == best, F.lit(x)) if out is None else F.when(s == best, F.lit(x)).otherwise(out)
    return out.cast("int")


def consensus(votes: DataFrame, weights: DataFrame, how: Spectral) -> DataFrame:
    """(item, label, confidence, agreement, n_raters).

    agreement: chance-corrected share of agreeing pairs of votes on the item (1 all agree, 0 as by chance).
    """
    K, D, p = len(how.labels), how.degrees, _shares(votes, how.labels)
    degree = F.least(F.greatest(F.floor((F.col("weight") + 1.0) * how.steps), F.lit(0)), F.lit(D - 1)).cast("int")
    # equal votes of an item are folded, so that a hot item costs as many rows as there are degrees and labels
    cells = cut(
        votes.join(weights.select("rater", "weight"), "rater")
        .groupBy("item", "label", degree.alias("degree"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    )
    centred = [F.sum(F.col("w") * (F.when(F.col("label") == x, 1.0).otherwise(0.0) - F.lit(p[k]))) for k, x in enumerate(how.labels)]
    counted = [F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"c{k}") for k, x in enumerate(how.labels)]
    scored = cells.groupBy("item").agg(*[s.alias(f"e{k}") for k, s in enumerate(centred)], *counted)
    scores = [F.col(f"e{k}") for k in range(K)]
    now = cut(scored.select("item", _best(scores, how.labels).alias("now"), *scores, *[f"c{k}" for k in range(K)]))
    for _ in range(how.rounds):
        worth, prior = _worth(cells, now, how)
        at = F.col("degree") * K + _of_label(how.labels, [F.lit(j) for j in range(K)])
        logs = [F.sum(F.col("n") * F.get(F.array(*[F.lit(worth[g][k][j]) for g in range(D) for j in range(K)]), at)).alias(f"e{k}") for k in range(K)]
        voted = cells.groupBy("item").agg(*logs).select("item", *[(F.col(f"e{k}") + F.lit(prior[k])).alias(f"e{k}") for k in range(K)])
        counts = now.select("item", *[f"c{k}" for k in range(K)])
        now = cut(voted.join(counts, "item").select("item", _best(scores, how.labels).alias("now"), *scores, *[f"c{k}" for k in range(K)]))
    top = F.greatest(*scores)
    mass = sum((F.exp(F.col(f"e{k}") - top) for k in range(1, K)), F.exp(F.col("e0") - top))
    n = sum((F.col(f"c{k}") for k in range(1, K)), F.col("c0"))
    pairs = sum((F.col(f"c{k}") * (F.col(f"c{k}") - 1.0) for k in range(1, K)), F.col("c0") * (F.col("c0") - 1.0))
    observed, chance = F.try_divide(pairs, n * (n - 1)), sum(x * x for x in p)
    agreement = (observed - F.lit(chance)) / F.lit(1.0 - chance) if chance < 1 else observed
    return now.select("item", F.col("now").alias("label"), (1.0 / mass).alias("confidence"), agreement.alias("agreement"), n.alias("n_raters"))


def _worth(cells: DataFrame, now: DataFrame, how: Spectral) -> tuple[list, list]:
    """log P(vote | label of the item, degree of reliability), and log P(label), from the present labels."""
    K, D = len(how.labels), how.degrees
    at = {x: k for k, x in enumerate(how.labels)}
    table = [[[1.0] * K for _ in range(K)] for _ in range(D)]
    got = cells.join(now.select("item", "now"), "item").groupBy("degree", "now", "label").agg(F.sum("n").alias("n"))
    for r in got.collect():  # at most degrees * labels * labels rows
        table[r["degree"]][at[r["now"]]][at[r["label"]]] += r["n"]
    items = {r["now"]: r["n"] for r in now.groupBy("now").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = sum(items.values()) + K
    return [[[math.log(v / sum(row)) for v in row] for row in t] for t in table], [math.log((items.get(x, 0) + 1.0) / size) for x in how.labels]


def note_votes(ratings: DataFrame, how: Spectral = Spectral()) -> DataFrame:
    return cut(newest_votes(ratings, "noteId", "raterId", "value", "createdAtMillis", how.labels))


def note_consensus(ratings: DataFrame, how: Spectral = Spectral()) -> DataFrame:
    """(noteId, label, confidence, agreement, n_raters) of every rated note."""
    votes = note_votes(ratings, how)
    return consensus(votes, reliability(votes, how), how).withColumnRenamed("item", "noteId")


def rater_reliability(ratings: DataFrame, how: Spectral = Spectral()) -> DataFrame:
    """(raterId, weight, n): weight 1 is the usual reliability, 0 none, below 0 reliably wrong."""
    votes = note_votes(ratings, how)
    return reliability(votes, how).withColumnRenamed("rater", "raterId")
