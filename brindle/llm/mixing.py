"""Mixing sources to target weights, each document used a capped number of times.

Iterative proportional fitting: the tokens of the cells (source, language, topic) are raked until they meet the
target share of each source and, as far as the caps allow, the corpus shares of each language and topic. A cell's
ratio of wanted to present tokens is then the expected number of copies of its documents; a document is taken the
whole part of it, and once more with the probability of the rest, by a fixed hash of mix and document.

Defined cases: documents without a source take no part; null texts have no tokens; languages are reduced to
two letters, all else is `und`; topics to their agenda number (a letter and up to four digits), all else is `other`, so
the cells of a mix are bounded by form; a null or negative share counts as 0, a null cap as 1; a source
listed twice in a mix counts once; a source without documents cannot reach a positive share; a source that
cannot reach its share is used to its cap, the others keep their sizes, and the reached shares are reported. Whether a
source reaches its share is read off its raked size; within rounding of the target the token counts decide. `misfit` of
a plan is how far the languages' and topics' shares are still off, as a share of all tokens: the caps may not allow them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.lexicon import FREQUENT, VOCABULARY, TransducerTokenizer
from brindle.session import cut

#: Codes of three letters that the corpus uses for languages of two.
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr"}
ROUNDS, TOLERANCE = 1000, 1e-9
#: Raked sizes within this share of their target are settled by the exact counts.
ROUNDING = 1e-6


def language(lang: Column) -> Column:
    code = F.lower(F.trim(lang))
    for long, short in LANGUAGES.items():
        code = F.when(code == long, short).otherwise(code)
    return F.when(code.rlike("^[a-z]{2}$"), code).otherwise("und")


def topic(agenda_item: Column) -> Column:
    number = F.regexp_extract(agenda_item, r"^\s*([A-Z]\d{2,4})\b", 1)
    return F.when(number != "", number).otherwise("other")


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, most: int = FREQUENT) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of the documents with a source."""
    tokens = TransducerTokenizer(documents, "text", vocabulary, most)
    return documents.filter(F.col("source").isNotNull()).select(
        "doc_id",
        "source",
        language(F.col("lang")).alias("lang"),
        topic(F.col("agenda_item")).alias("topic"),
        tokens.count(F.col("text")).alias("tokens"),
    )


def rake(tokens: np.ndarray, cap: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sizes w of cells with w <= cap * tokens, proportional to `tokens` within the scaling of the margins.

    margins: (group of each cell, target of each group); the first is met exactly wherever the caps allow it.
    """
    most = cap * tokens
    w = np.minimum(tokens.astype(float), most)
    for _ in range(ROUNDS):
        before = w
        for group, target in margins[::-1]:
            now = np.bincount(group, w, len(target))
            w = np.minimum(w * np.divide(target, now, out=np.zeros(len(target)), where=now > 0)[group], most)
        if np.abs(w - before).sum() <= TOLERANCE * max(1.0, w.sum()):
            break
    group, target = margins[0]
    for _ in range(len(w)):  # what the caps cut off goes to the source's other cells
        now, free = np.bincount(group, w, len(target)), w < most
        room = np.bincount(group, np.where(free, w, 0.0), len(target))
        lack = target - now
        factor = np.divide(lack, room, out=np.zeros(len(target)), where=room > 0)
        if not (np.abs(lack) > 1e-7 * np.maximum(1.0, target))[room > 0].any():
            break
        w = np.minimum(w * np.where(free, 1.0 + factor[group], 1.0), most)
    return w


_PLAN = (
    "mix_id int, source string, lang string, topic string, target_share double, max_repeat int, source_tokens long, "
    "total_tokens long, reachable boolean, cell_tokens long, copies double, misfit double"
)


def _plan_mix(rows: pd.DataFrame) -> pd.DataFrame:
    """One mix: its cells with the expected number of copies of their documents."""
    tokens = rows["cell_tokens"].to_numpy(dtype=float)
    share, cap = rows["target_share"].to_numpy(dtype=float), rows["max_repeat"].to_numpy(dtype=float)
    total = rows["total_tokens"].to_numpy(dtype=float)
    source, names = pd.factorize(rows["source"])
    wanted = np.zeros(len(names))
    wanted[source] = share * total
    within = np.zeros(len(names))
    within[source] = np.minimum(share * total, cap * rows["source_tokens"].to_numpy(dtype=float))
    margins = [(source, wanted)]
    for c in ("lang", "topic"):
        group, values = pd.factorize(rows[c])
        of_corpus = np.zeros(len(values))
        of_corpus[group] = rows[f"{c}_tokens"].to_numpy(dtype=float)
        margins.append((group, of_corpus / max(of_corpus.sum(), 1.0) * within.sum()))
    w = rake(tokens, cap, margins)
    size = np.bincount(source, w, len(names))[source]
    rows["copies"] = np.minimum(np.divide(w, tokens, out=np.zeros(len(w)), where=tokens > 0), cap)
    exact = np.array([int(r) * int(n) < s * int(t) for r, n, s, t in zip(rows["max_repeat"], rows["source_tokens"], share, rows["total_tokens"])], dtype=bool)
    near = np.abs(size - wanted[source]) <= ROUNDING * wanted[source]
    rows["reachable"] = ~np.where(near, exact, size < wanted[source])
    rows["misfit"] = max(float(np.abs(np.bincount(g, w, len(t)) - t).sum()) for g, t in margins[1:]) / max(within.sum(), 1.0)
    return rows[[c.split()[0] for c in _PLAN.split(", ")]]


def mix_plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The raked plan of every mix by cell; documents as made by `sized`."""
    # written once: texts are encoded here, and the few cells are read several times below
    cells = cut(documents.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("cell_tokens")))
    sums = (
        cells.groupingSets([["source"], ["lang"], ["topic"], []], "source", "lang", "topic")
        .agg(F.sum("cell_tokens").alias("tokens"), F.grouping_id().alias("level"))
        .select("level", F.coalesce("source", "lang", "topic", F.lit("")).alias("name"), "tokens")
    )

    def of(level: int, key: str) -> DataFrame:
        return sums.filter(F.col("level") == level).select(F.col("name").alias(key), F.col("tokens").alias(f"{key}_tokens"))

    want = targets.filter(F.col("mix_id").isNotNull() & F.col("source").isNotNull()).groupBy("mix_id", "source").agg(
        F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"),
    )
    rows = (
        want.join(cells, "source", "left")
        .join(of(3, "source"), "source", "left")
        .join(of(5, "lang"), "lang", "left")
        .join(of(6, "topic"), "topic", "left")
        .withColumn("total_tokens", F.coalesce(sums.filter("level = 7").select("tokens").scalar(), F.lit(0)))
    )
    rows = rows.fillna(0, [c for c in rows.columns if c.endswith("_tokens")]).fillna("", ["lang", "topic"])
    return rows.groupBy("mix_id").applyInPandas(_plan_mix, _PLAN)


def unreachable(plan: DataFrame) -> DataFrame:
    """(mix_id, source) of the targets that the cap keeps out of reach."""
    return plan.groupBy("mix_id", "source").agg(F.min("reachable").alias("ok")).filter(~F.col("ok")).select("mix_id", "source")


def sample(documents: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_id, doc_id, source, tokens, copies) of the documents taken."""
    cells = plan.filter(F.col("copies") > 0).select("mix_id", "source", "lang", "topic", "copies")
    taken = documents.join(cells, ["source", "lang", "topic"])
    draw = F.pmod(F.xxhash64(F.col("mix_id"), F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor(F.col("copies"))
    number = (whole + F.when(draw < F.col("copies") - whole, 1).otherwise(0)).cast("int")
    return taken.select("mix_id", "doc_id", "source", "tokens", number.alias("copies")).filter(F.col("copies") > 0)


def reached(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """Per target: wanted and reached share, planned and sampled tokens, whether the cap allows the share."""
    planned = plan.groupBy("mix_id", "source").agg(
        F.max("target_share").alias("target_share"),
        F.max("max_repeat").alias("max_repeat"),
        F.max("source_tokens").alias("source_tokens"),
        F.min("reachable").alias("reachable"),
        F.sum(F.col("copies") * F.col("cell_tokens")).alias("planned_tokens"),
        F.max("misfit").alias("misfit"),
    )
    got = taken.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("sampled_tokens"), F.max("copies").alias("most_copies")
    )
    out = planned.join(got, ["mix_id", "source"], "left").fillna(0, ["sampled_tokens", "most_copies"])
    sums = out.groupBy("mix_id").agg(F.sum("sampled_tokens").alias("mix_tokens"))
    return out.join(sums, "mix_id").withColumn("reached_share", F.coalesce(F.try_divide("sampled_tokens", "mix_tokens"), F.lit(0.0)))
