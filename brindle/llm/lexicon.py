"""Token ids of a public byte-level BPE through a minimal acyclic transducer.

A text falls apart into units that no token crosses: a run of non-blanks with the single space before it, or
a run of blanks. The frequent units of the corpus are compiled, with their ids, into a minimal acyclic
automaton that shares prefixes and suffixes; its arcs carry numbers whose sum along a word is the word's place in
the table of ids. The automaton is one file that every worker maps into memory. Per batch each distinct unit is
looked up once; a unit the automaton doesn't hold is merged exactly by the tokenizer's own rules.

Defined cases: null and empty texts give no ids; text that looks like a special token is ordinary text; very
long units and texts are whole; the order of rows doesn't matter; extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of byte-level BPE into parts that are merged on their own (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters with the Unicode property White_Space.
BLANKS = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
LONGEST = 40  # bytes of a unit in the lexicon
FREQUENT = 50_000  # units in the lexicon
BATCH_CHARS = 4_000_000  # characters encoded at once in a worker


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------------------------------------
# the automaton


class _Node:
    __slots__ = ("arcs", "final", "id", "count")

    def __init__(self):
        self.arcs: dict[int, _Node] = {}
        self.final, self.id, self.count = False, -1, 0

    def key(self) -> tuple:
        return (self.final, *[(b, n.id) for b, n in self.arcs.items()])


def _minimal(words: list[bytes]) -> tuple[_Node, list[_Node]]:
    """The minimal acyclic automaton of sorted distinct words, built word by word; nodes in order of finishing."""
    root, register, nodes = _Node(), {}, []
    path: list[tuple[_Node, int, _Node]] = []

    def finish(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            known = register.get(child.key())
            if known is not None:
                parent.arcs[byte] = known
            else:
                child.id = len(nodes)
                nodes.append(child)
                register[child.key()] = child

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        finish(same)
        node = path[-1][2] if path else root
        for byte in word[same:]:
            child = _Node()
            node.arcs[byte] = child
            path.append((node, byte, child))
            node = child
        node.final = True
        last = word
    finish(0)
    root.id = len(nodes)
    nodes.append(root)
    return root, nodes


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The lexicon of words and their ids as one block: a header and arrays that can be mapped into memory."""
    words = sorted(entries)
    root, nodes = _minimal(words)
    for n in nodes:  # children are finished before their parents
        n.count = n.final + sum(c.count for c in n.arcs.values())
    keys, to, add = [], [], []
    for n in nodes:
        passed = int(n.final)
        for byte, child in sorted(n.arcs.items()):
            keys.append(n.id * 256 + byte), to.append(child.id), add.append(passed)
            passed += child.count
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    lengths = np.array([len(entries[w]) for w in words], dtype=np.int64)
    arrays = {
        "key": np.array(keys, dtype=np.int64)[order],
        "to": np.array(to, dtype=np.int32)[order],
        "add": np.array(add, dtype=np.int32)[order],
        "final": np.array([n.final for n in nodes], dtype=np.uint8),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for w in words for i in entries[w]], dtype=np.int32),
    }
    head, body, at = {"root": root.id}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes()
        head[name] = [a.dtype.str, len(a), at]
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return struct.pack("<q", len(text)) + text + b"".join(body)


class Lexicon:
    """A compiled lexicon, mapped into memory from a file (or held, when given as bytes)."""

    def __init__(self, source: str | bytes):
        raw = np.frombuffer(source, dtype=np.uint8) if isinstance(source, bytes) else np.memmap(source, dtype=np.uint8, mode="r")
        size = int(raw[:8].view(np.int64)[0])
        head = json.loads(raw[8 : 8 + size].tobytes())
        self.root = head.pop("root")
        for name, (kind, n, at) in head.items():
            begin = 8 + size + at
            setattr(self, name, raw[begin : begin + n * np.dtype(kind).itemsize].view(kind))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table of ids, -1 where the lexicon doesn't hold it; all words step together."""
        n = np.array([len(w) for w in words], dtype=np.int64)
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(words) or not len(self.key):
            return out
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        alive = np.flatnonzero((n > 0) & (n <= LONGEST))
        state, place = np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(alive):
            wanted = state[alive] * 256 + text[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            alive, at = alive[hit], at[hit]
            state[alive], place[alive] = self.to[at], place[alive] + self.add[at]
            step += 1
            ends = alive[n[alive] == step]
            ends = ends[self.final[state[ends]] == 1]
            out[ends] = place[ends]
            alive = alive[n[alive] > step]
        return out


class _Numbered(dict):
    """Numbers keys in order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def encode_texts(texts: list[str | None], lexicon: Lexicon, merge) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts; merge: exact ids of one unit."""
    number = _Numbered()
    split, get = UNIT.findall, number.__getitem__
    codes: list[int] = []
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            codes.extend(map(get, split(t)))
        ends[i + 1] = len(codes)
    units = list(number)
    place = lexicon.find([u.encode() for u in units])
    lengths, begins = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
    known = place >= 0
    begins[known] = lexicon.start[place[known]]
    lengths[known] = lexicon.start[place[known] + 1] - begins[known]
    more: list[int] = []
    for i in np.flatnonzero(~known):
        ids = merge(units[i])
        begins[i], lengths[i] = len(lexicon.ids) + len(more), len(ids)
        more.extend(ids)
    pool = np.concatenate([lexicon.ids, np.array(more, dtype=np.int32)])
    of = np.array(codes, dtype=np.int64)
    n = lengths[of]
    stops = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat(begins[of] - stops[:-1], n) + np.arange(stops[-1])] if len(of) else np.zeros(0, dtype=np.int32)
    return stops[ends], ids


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


# ---------------------------------------------------------------------------------------------
# Spark


def _count_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [(u, n) for u, n in counts.items() if len(u) <= LONGEST]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["unit", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                counts.update(UNIT.findall(t))
        if len(counts) > 200_000:
            yield out()
    yield out()


def frequent_units(documents: DataFrame, text: str = "text", most: int = FREQUENT) -> list[str]:
    """The most frequent units of all texts, at most `most` (the size of the lexicon, whatever the corpus)."""
    counts = documents.select(F.col(text).cast("string")).mapInArrow(_count_units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "unit").limit(most)
    return [r["unit"] for r in top.collect()]


def ship_lexicon(spark: SparkSession, block: bytes) -> str:
    """Puts the compiled lexicon into the shared folder and gives it to every executor; returns its file name."""
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:24]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    stream.write(bytearray(block))
    stream.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


class TransducerTokenizer:
    """Encodes text columns with a lexicon compiled from the corpus itself."""

    def __init__(self, documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, most: int = FREQUENT):
        merge = tokenizer(vocabulary).encode_ordinary
        entries = {u.encode(): merge(u) for u in frequent_units(documents, text, most) if len(u.encode()) <= LONGEST}
        self.vocabulary, self.size = vocabulary, len(entries)
        self.name = ship_lexicon(documents.sparkSession, compile_lexicon(entries))

    def ids(self, text: Column) -> Column:
        """ARRAY<INT> of token ids; empty for null and empty texts."""
        name, vocabulary = self.name, self.vocabulary

        @F.arrow_udf("array<int>")
        def encode(column: pa.Array) -> pa.Array:
            lexicon, merge = _mapped(name), tokenizer(vocabulary).encode_ordinary
            parts = []
            for texts in _slices(column.to_pylist()):
                offsets, ids = encode_texts(texts, lexicon, merge)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

        return encode(text.cast("string"))

    def count(self, text: Column) -> Column:
        """Number of tokens (BIGINT); 0 for null and empty texts."""
        name, vocabulary = self.name, self.vocabulary

        @F.arrow_udf("long")
        def count(column: pa.Array) -> pa.Array:
            lexicon, merge = _mapped(name), tokenizer(vocabulary).encode_ordinary
            parts = [np.diff(encode_texts(texts, lexicon, merge)[0]) for texts in _slices(column.to_pylist())]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())

        return count(text.cast("string"))
