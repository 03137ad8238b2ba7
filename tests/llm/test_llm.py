"""Consensus, tokenizer, mixing and reading levels against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import consensus, lexicon, mixing, queries, reading
from brindle.session import cut, table
from tests.conftest import DATA

# ---------------------------------------------------------------------------------------------
# consensus


def synthetic(seed=0, items=250, raters=60):
    rng = np.random.default_rng(seed)
    truth = rng.choice([-1, 0, 1], items)
    kind = rng.choice(3, raters, p=[0.65, 0.15, 0.2])
    rows = []
    for i in range(items):
        for r in rng.choice(raters, 13, replace=False):
            v = truth[i] if rng.random() < 0.75 else rng.choice([-1, 0, 1])
            v = v if kind[r] == 0 else rng.choice([-1, 0, 1]) if kind[r] == 1 else (-v if v else rng.choice([-1, 1]))
            rows.append((i, f"R{r}", float(v), 1))
    return truth, kind, rows


def test_consensus_beats_the_majority(spark):
    truth, kind, rows = synthetic()
    df = spark.createDataFrame(rows, "noteId long, raterId string, value double, createdAtMillis long")
    got = {r["noteId"]: r["label"] for r in consensus.note_consensus(df).collect()}
    right = np.mean([got[i] == t for i, t in enumerate(truth)])
    sums = [np.bincount([int(v) + 1 for n, _, v, _ in rows if n == i], minlength=3).argmax() - 1 for i in range(len(truth))]
    assert right > 0.9 and right > np.mean([a == b for a, b in zip(sums, truth)])
    weight = {r["raterId"]: r["weight"] for r in consensus.rater_reliability(df).collect()}
    means = [np.mean([w for r, w in weight.items() if kind[int(r[1:])] == k]) for k in range(3)]
    assert means[0] > 0.9 > means[1] > means[2] and means[2] < 0


def test_votes_are_cleaned(spark):
    rows = [(1, " Ab ", 1.0, 5), (1, "aB", -1.0, 9), (1, "ab", None, 10), (1, "c", float("nan"), 1), (1, "d", 0.5, 1), (1, None, 1.0, 1), (None, "e", 1.0, 1), (1, "f", 0.0, None), (1, "f", 1.0, None), (1, "f", 1.0, None)]
    df = spark.createDataFrame(rows, "noteId long, raterId string, value double, createdAtMillis long").withColumn("label", F.lit("x")).withColumn("item", F.lit(0))
    votes = consensus.newest_votes(df, "noteId", "raterId", "value", "createdAtMillis", (-1, 0, 1))
    assert sorted(map(tuple, votes.collect())) == [(1, "ab", -1), (1, "f", 1)]


def test_consensus_of_nothing(spark):
    df = spark.createDataFrame([], "noteId long, raterId string, value double, createdAtMillis long")
    assert consensus.note_consensus(df).count() == 0 and consensus.rater_reliability(df).count() == 0


# ---------------------------------------------------------------------------------------------
# tokenizer

MERGE = lexicon.tokenizer(lexicon.VOCABULARY)
WORDS = ["the", " the", " there", " then", "ing", " king", "  ", "\n\n", " a", " é", "<|endoftext|>"]
LEXICON = lexicon.Lexicon(lexicon.compile_lexicon({w.encode(): MERGE.encode_ordinary(w) for w in WORDS}))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r  　\u001c the kingz'sé.,1<|>")), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_units_give_the_ids_of_the_whole_text(text):
    offsets, ids = lexicon.encode_texts([text, None, ""], LEXICON, MERGE.encode_ordinary)
    assert ids.tolist() == MERGE.encode_ordinary(text) and offsets.tolist() == [0, len(ids), len(ids), len(ids)]
    assert "".join(lexicon.UNIT.findall(text)) == text


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted(w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", ""] if w)
    block = lexicon.Lexicon(lexicon.compile_lexicon({w: [i] for i, w in enumerate(words)}))
    assert block.find(words).tolist() == list(range(len(words)))
    assert block.find([b"", b"ta", b"tapss", b"xtop"]).tolist() == [-1] * 4
    assert len(block.final) < sum(len(w) for w in words) / 2  # prefixes and suffixes are shared
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).find([b"a"]).tolist() == [-1]


def test_ids_of_all_documents(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(lexicon.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    docs = table(spark, DATA, "documents")
    want = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, DATA).collect()} == want


def test_hard_texts(spark):
    texts = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "x" * 50_000), (6, "a  b   c \n\n d "), (7, "naïve 日本語 🙂🙂"), (7, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("unit", F.lit("u"))
    tokens = lexicon.TransducerTokenizer(docs, most=5)
    rows = docs.select("doc_id", "text", tokens.ids(F.col("text")).alias("i"), tokens.count(F.col("text")).alias("n")).collect()
    assert all(r["i"] == MERGE.encode_ordinary(r["text"] or "") and r["n"] == len(r["i"]) for r in rows) and len(rows) == len(texts)
    assert docs.limit(0).select(lexicon.TransducerTokenizer(docs.limit(0)).ids(F.col("text"))).count() == 0


# ---------------------------------------------------------------------------------------------
# mixing


def test_raking_meets_the_margins():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 100, 24).astype(float)
    a, b = np.arange(24) // 6, np.arange(24) % 6
    ta, tb = np.array([0.4, 0.3, 0.2, 0.1]) * tokens.sum(), np.full(6, tokens.sum() / 6)
    w = mixing.rake(tokens, np.full(24, 50.0), [(a, ta), (b, tb)])
    assert np.allclose(np.bincount(a, w), ta) and np.allclose(np.bincount(b, w), tb, rtol=1e-3)
    capped = mixing.rake(tokens, np.where(a == 0, 1.0, 50.0), [(a, np.minimum(ta, np.where(np.arange(4) == 0, np.bincount(a, tokens), 1e9))), (b, tb)])
    assert (capped <= tokens * np.where(a == 0, 1.0, 50.0) + 1e-6).all()


def test_shares_and_caps(spark):
    size = "doc_id long, source string, lang string, topic string, tokens long"
    docs = cut(spark.createDataFrame([(i, "ab"[i % 2], "en", f"A0{i % 3}", 10) for i in range(2000)] + [(9999, "c", "de", "other", 10), (9998, "c", "de", "other", 0)], size))
    targets = spark.createDataFrame([(1, "a", 0.8, 3), (1, "b", 0.2, 1), (2, "a", 0.1, 1), (2, "b", 0.1, 1), (2, "c", 0.8, 5), (2, "none", 0.0, 1), (3, "gone", 1.0, 2), (3, "gone", 1.0, 2)], "mix_id int, source string, target_share double, max_repeat int")
    plan = cut(mixing.mix_plan(docs, targets))
    assert {tuple(r) for r in mixing.unreachable(plan).collect()} == {(2, "c"), (3, "gone")}
    taken = cut(mixing.sample(docs, plan))
    got = {(r["mix_id"], r["source"]): r for r in mixing.reached(plan, taken).collect()}
    assert abs(got[1, "a"]["reached_share"] - 0.8) < 0.02 and got[1, "a"]["most_copies"] <= 3 and got[2, "c"]["sampled_tokens"] == 50
    assert taken.groupBy("mix_id", "doc_id").count().filter("count > 1").count() == 0
    assert mixing.sample(docs, plan).exceptAll(taken).count() == 0  # drawn the same again


def test_languages_and_topics(spark):
    rows = spark.createDataFrame([("EN", "A03 Road"), ("eng", None), (None, "B1"), ("und", " A11 x"), (" de ", "")], "lang string, agenda_item string")
    got = [tuple(r) for r in rows.select(mixing.language(F.col("lang")), mixing.topic(F.col("agenda_item"))).collect()]
    assert got == [("en", "A03"), ("en", "other"), ("und", "other"), ("und", "A11"), ("de", "other")]


# ---------------------------------------------------------------------------------------------
# reading levels


def test_sentences():
    words, lengths = reading.words_and_sentences("Mr. Smith (Applause. Hear!) said 2.5 things. Really?! [Order] Art. 5 holds\n\nNew part")
    assert words == ["mr", "smith", "said", "things", "really", "art", "holds", "new", "part"] and lengths == [4, 1, 2, 2]
    assert reading.words_and_sentences("") == ([], []) and reading.words_and_sentences("12 34 …") == ([], [])


def test_levels_on_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = table(spark, root, "documents"), table(spark, root, "reading_labels")
    held = labels.filter("doc_id % 4 = 0")
    got = {r["doc_id"]: r["band"] for r in reading.reading_levels(docs, labels.filter("doc_id % 4 <> 0")).collect()}
    rows = held.collect()
    assert np.mean([got[r["doc_id"]] == r["band"] for r in rows]) > 0.8 and len(rows) > 20
    long = docs.filter(F.size(F.split(F.trim("text"), r"\s+")) >= 80).count()
    assert abs(sum(b is not None for b in got.values()) - long) <= 5 and len(got) == docs.count()


def test_levels_of_odd_documents(spark):
    plain, hard = "We go home now. The dog is old. " * 20, "Notwithstanding intergovernmental indemnification and the macroprudential adjudication thereof " * 20
    rows = [(i, plain if i % 2 else hard, "en") for i in range(20)] + [(50, None, None), (51, "", "en"), (52, " \n", None), (53, "1 2 3", "en"), (54, "short text", "xx"), (55, plain, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("band", F.lit(9)).withColumn("word", F.lit("w"))
    labels = spark.createDataFrame([(i, 1 if i % 2 else 3) for i in range(10)] + [(777, 2), (3, None), (4, 8)], "doc_id long, band int")
    got = {r["doc_id"]: r for r in reading.reading_levels(docs, labels).collect()}
    assert all(got[i]["band"] == (1 if i % 2 else 3) for i in range(20)) and got[55]["band"] == 1
    assert all(got[i]["band"] is None for i in range(50, 55)) and got[50]["unfamiliar"] is None
    none = reading.reading_levels(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r["band"] is None for r in none)
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
