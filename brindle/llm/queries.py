"""Queries of the operators in this package. None of them has SQL: `tests/llm` holds them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import consensus, lexicon, mixing, reading
from brindle.session import cut, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    how = consensus.Spectral()
    found = consensus.note_consensus(table(spark, d, "ratings"), how)
    return found.filter(F.col("n_raters") >= how.least_raters).select("noteId", "label")


def p5_notes(spark: SparkSession, d: str) -> DataFrame:
    """Label, confidence and agreement of every rated note."""
    return consensus.note_consensus(table(spark, d, "ratings"))


def p5_raters(spark: SparkSession, d: str) -> DataFrame:
    return consensus.rater_reliability(table(spark, d, "ratings"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    tokens = lexicon.TransducerTokenizer(documents)
    return documents.select("doc_id", tokens.ids(F.col("text")).alias("ids"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return mixing.unreachable(plan)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of every source in every mix."""
    documents = cut(mixing.sized(table(spark, d, "documents")))
    plan = cut(mixing.mix_plan(documents, table(spark, d, "mix_targets")))
    return mixing.reached(plan, mixing.sample(documents, plan))


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix with their number of copies."""
    documents = cut(mixing.sized(table(spark, d, "documents")))
    return mixing.sample(documents, mixing.mix_plan(documents, table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return levels.filter(F.col("band").isNotNull()).select("doc_id", "band")


def p9_two_terms(spark: SparkSession, d: str) -> DataFrame:
    """Bands by the two-term formula alone: share of words outside the list and sentence length."""
    levels = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), reading.ReadingModel(two_terms=True))
    return levels.filter(F.col("band").isNotNull()).select("doc_id", "band")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {
    "p5_found": p5_found,
    "p5_notes": p5_notes,
    "p5_raters": p5_raters,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_sample": p8_sample,
    "p9_found": p9_found,
    "p9_two_terms": p9_two_terms,
    "p9_levels": p9_levels,
}

SQL: dict[str, str] = {}
