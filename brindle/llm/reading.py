"""Reading level of each document: a familiar-word formula whose word list comes from the corpus itself.

A document's language is that whose most frequent words cover it best (the given `lang` is sometimes missing or
wrong). Words are familiar by the share of the documents given as of that language that hold them. The two-term formula is
the share of words outside the list and the average sentence length (its logarithm); the full one takes the share at
several familiarities and adds word length and the share of long sentences. The weights of either and the familiarity of
the two-term list are fitted by ridge-penalised multinomial logistic regression on labelled documents (at most
`max_labels`, see `ReadingModel`).

Defined cases: interjections in brackets (of at most 300 characters: longer ones are unclosed and hold speech) are not read; full stops of abbreviations, initials and numbers end no
sentence; null, empty and wordless texts have NULL features and no level; documents of fewer than `min_words`
words get features and no level; labels of unknown documents, null or other labels are ignored, several labels of a
document count as several; with labels of a single band all documents get that band; without labels there is no
level at all; extra columns are left alone; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.mixing import language
from brindle.session import cut

BANDS = (1, 2, 3)
MIN_WORDS = 80
#: Familiarities (shares of a language's documents) at which the share of rarer words is taken.
LEVELS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)
#: Words in fewer documents than this share are in no list. A list thus holds at most (mean distinct words of a document) / LISTED words.
LISTED = 0.005
PROFILE = 60  # most frequent words that tell a language
FEATURES = len(LEVELS) + 5

_DROP = re.compile(r"\[[^\]]{0,300}\]|\([^)]{0,300}\)")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_END = re.compile(r"[.!?…]+[\"»”’)]*\s+|\n\s*\n")
#: Words whose full stop ends no sentence (fixed values), beside single letters.
ABBREVIATIONS = frozenset(
    "art para no approx p dist hon mr mrs dr ms st vgl abs nr ca bzw mme al env cf".split()
)


def words_and_sentences(text: str) -> tuple[list[str], list[int]]:
    """Lower-case words of a text and the number of words of each sentence."""
    words: list[str] = []
    lengths: list[int] = []
    begun = 0
    find = _WORD.findall
    for part in _END.split(_DROP.sub(" ", text.lower())):
        more = find(part)
        if more:
            words += more
            last = more[-1]
            if (len(last) == 1 or last in ABBREVIATIONS) and part.endswith(last):
                continue  # the full stop belongs to the word: the sentence goes on
        if len(words) > begun:
            lengths.append(len(words) - begun)
            begun = len(words)
    if len(words) > begun:
        lengths.append(len(words) - begun)
    return words, lengths


def _document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over (lang, text): (lang, word, n) partial document frequencies; the word '' counts documents."""
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(g, w, n) for g, c in counts.items() for w, n in c.items()]
        counts.clear()
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                words = set(words_and_sentences(text)[0])
                if words:
                    words.add("")
                    counts.setdefault(lang, Counter()).update(words)
        if sum(map(len, counts.values())) > 200_000:
            yield out()
    yield out()


class _Shares(dict):
    """Familiarity of words; 0 for those in no list."""

    def __missing__(self, word: str) -> float:
        return 0.0


class WordLists:
    """Familiar words by language, and the most frequent of them, by which a text's language is told."""

    def __init__(self, shares: dict[str, dict[str, float]], sizes: dict[str, int]):
        most = sorted(shares, key=lambda g: (-sizes[g], g))
        self.shares = {g: _Shares(shares[g]) for g in most}
        self.profiles = {g: frozenset(sorted(shares[g], key=lambda w: (-shares[g][w], w))[:PROFILE]) for g in most}

    @classmethod
    def of(cls, texts: DataFrame) -> WordLists:
        """From the document frequencies of all (lang, text); documents of no known language are counted as `und`.

        Languages are two letters by form, so there are at most 676 lists, each bounded by LISTED.
        """
        counts = cut(texts.mapInArrow(_document_frequencies, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
        counts = counts.filter(F.col("lang") != "und")
        sizes = {r["lang"]: r["n"] for r in counts.filter("word = ''").collect()}
        least = counts.filter("word = ''").select(F.col("lang").alias("__g"), (F.col("n") * F.lit(LISTED)).alias("__least"))
        kept = counts.filter("word <> ''").join(least, F.col("lang") == F.col("__g")).filter(F.col("n") >= F.col("__least"))
        shares: dict[str, dict[str, float]] = {g: {} for g in sizes}
        for r in kept.select("lang", "word", "n").collect():
            shares[r["lang"]][r["word"]] = r["n"] / sizes[r["lang"]]
        return cls(shares, sizes)

    def language(self, words: set[str]) -> str | None:
        best, found = 0, None
        for g, p in self.profiles.items():
            if (n := len(p & words)) > best:
                best, found = n, g
        return found


def features_of(texts: list[str | None], lists: WordLists) -> tuple[np.ndarray, np.ndarray]:
    """(index, features) of the texts that hold words, computed for all of them together."""
    at, share, n_words, letters, sentences, n_sentences = [], [], [], [], [], []
    none = _Shares()
    for i, text in enumerate(texts):
        if not text:
            continue
        words, lengths = words_and_sentences(text)
        if words:
            at.append(i)
            known = lists.shares.get(lists.language(set(words)), none)
            share += map(known.__getitem__, words)
            n_words.append(len(words))
            letters.append(len("".join(words)))
            sentences += lengths
            n_sentences.append(len(lengths))
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros((0, FEATURES))
    x, n = np.array(share), np.array(n_words, dtype=float)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    s, m = np.array(sentences, dtype=float), np.array(n_sentences, dtype=float)
    begin = np.concatenate([[0], np.cumsum(n_sentences)[:-1]])
    columns = [np.add.reduceat((x < h).astype(float), first) / n for h in LEVELS]
    columns += [
        np.log(n / m),
        np.log(np.add.reduceat(s * s, begin) / n),
        np.array(letters) / n,
        np.add.reduceat(np.log(x + 1e-4), first) / n,
        np.add.reduceat((s > 25).astype(float), begin) / m,
    ]
    return np.array(at, dtype=np.int64), np.stack(columns, axis=1)


def fit_bands(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 600) -> dict:
    """Multinomial logistic regression by gradient descent on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    bands = sorted(set(int(v) for v in y))
    target = (y[:, None] == np.array(bands)[None]).astype(float)
    keep = np.r_[np.ones(x.shape[1]), 0.0][:, None] * penalty
    step = 1.0 / (0.5 * np.linalg.norm(z, 2) ** 2 + penalty)
    b = np.zeros((z.shape[1], len(bands)))
    v = b.copy()
    for k in range(steps):  # with Nesterov's momentum
        p = np.exp(z @ v - (z @ v).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - step * (z.T @ (p - target) + keep * v)
        v, b = new + k / (k + 3.0) * (new - b), new
    return {"mean": mean, "scale": scale, "weights": b, "bands": bands}


#: Columns of the two-term formula at each familiarity: share of words outside the list, log of words a sentence.
TWO_TERMS = [[k, len(LEVELS)] for k in range(len(LEVELS))]


def fit_two_terms(x: np.ndarray, y: np.ndarray) -> dict:
    """The two-term formula at the familiarity that fits the labels best, of equal ones the lowest."""
    fits = [fit_bands(x[:, c], y) | {"columns": c} for c in TWO_TERMS]
    return max(fits, key=lambda m: (predict_bands(m, x) == y).sum())


def predict_bands(model: dict, x: np.ndarray) -> np.ndarray:
    x = x[:, model["columns"]] if "columns" in model else x
    z = np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))]
    return np.array(model["bands"])[(z @ model["weights"]).argmax(1)]


@dataclass(frozen=True)
class ReadingModel:
    """min_words: words (separated by blanks) a document needs for a level; max_labels: labels used in the fit, by hash."""

    min_words: int = MIN_WORDS
    max_labels: int = 10_000
    two_terms: bool = False

    def levels(self, documents: DataFrame, labels: DataFrame) -> DataFrame:
        """(doc_id, band, unfamiliar, sentence_words, word_letters) of all documents; band NULL where there is no level."""
        lists = WordLists.of(documents.select(language(F.col("lang")).alias("lang"), F.col("text")))
        shared = documents.sparkSession.sparkContext.broadcast(lists)  # bounded: see LISTED

        def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = features_of(batch.column(0).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).take(pa.array(at))], ["x", "band"])

        chosen = (
            labels.filter(F.col("band").isin(*BANDS))
            .select("doc_id", F.col("band").cast("int").alias("band"))
            .orderBy(F.xxhash64("doc_id", "band"), "doc_id", "band")
            .limit(self.max_labels)
        )
        known = documents.select("doc_id", "text").join(chosen, "doc_id").select("text", "band")
        rows = sorted((r["band"], tuple(r["x"])) for r in known.mapInArrow(features, "x array<double>, band int").collect())
        fitted = fit_two_terms if self.two_terms else fit_bands
        model = fitted(np.array([r[1] for r in rows]), np.array([r[0] for r in rows])) if rows else None
        least = self.min_words

        def level(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                at, x = features_of(texts, shared.value)
                bands: list[int | None] = [None] * len(texts)
                values: list[list[float | None]] = [[None] * len(texts) for _ in range(3)]
                found = predict_bands(model, x) if model is not None and len(at) else np.zeros(len(at))
                for k, i in enumerate(at):
                    if model is not None and len(texts[i].split()) >= least:
                        bands[i] = int(found[k])
                    values[0][i], values[1][i], values[2][i] = x[k, 3], float(np.exp(x[k, len(LEVELS)])), x[k, len(LEVELS) + 2]
                columns = [batch.column(0), pa.array(bands, pa.int32()), *[pa.array(v, pa.float64()) for v in values]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "band", "unfamiliar", "sentence_words", "word_letters"])

        schema = "doc_id long, band int, unfamiliar double, sentence_words double, word_letters double"
        return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(level, schema)


def reading_levels(documents: DataFrame, labels: DataFrame, model: ReadingModel = ReadingModel()) -> DataFrame:
    return model.levels(documents, labels)


