"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability ``sigmoid(bias + sum of the
weights of its words)``; a document is toxic if any sentence is (noisy-or). Only document
labels are needed for training; the sentence scores then locate what is offending.

A word's weight is the sum over its features: the word itself and its character n-grams with
word ends marked, so inflected and unseen forms of a stem score too.
"""

from __future__ import annotations

import dataclasses
import pickle
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm._common import held, lean
from gridloom.llm.tokenizing import Memory

#: Bounds of the training sample: documents of each label, and bytes of text in all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1200, 2400, 16_000_000
#: Longer labelled texts don't train, so that one of them can't take the place of all others.
LONGEST_BYTES = 250_000
#: A feature needs this many toxic documents, this log-likelihood ratio, and a share among toxic
#: documents this many times that among clean ones.
LEAST_DOCS, LEAST_RATIO, LEAST_LIFT, MOST_FEATURES = 4, 18.0, 6.0, 20_000
NGRAMS = (4, 5, 6)
#: Words whose weights a worker remembers at least, and half of those at most.
WORDS = 100_000

_MARKS = re.compile(r"[.!?\n]+")
_END = b"\x00"
#: ASCII punctuation parts words; sentence marks become a word of their own.
_PLAIN = bytes(ord("\n") if chr(b) in ".!?\n" else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def held_out(doc_id: Column, of: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == 0


def _tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).replace(b"\n", b" \x00 ").split()


def features(word: bytes) -> list[str]:
    w = f"^{word.decode('utf-8', 'replace')}$"
    return [w, *{w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)} - {w}]


@dataclasses.dataclass(frozen=True)
class Model:
    """``weights`` by feature, of which there are at most ``MOST_FEATURES``."""

    weights: dict
    bias: float

    def word(self, word: bytes) -> float:
        return sum(map(self.weights.get, features(word), repeat(0.0)))


def _near_copies(docs: list[list[bytes]]) -> list[bool]:
    """Marks documents that share one of four minimum shingles with an earlier one: copies of
    one text would else make all its words look telling."""
    ids: dict[bytes, int] = {}
    rng = np.random.default_rng(4)
    odd = rng.integers(0, 2**63, (4, 2), dtype=np.uint64) | np.uint64(1)
    seen, out = set(), []
    for words in docs:
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words)) + np.uint64(1)
        k = min(5, len(a)) or 1
        h = np.zeros(max(len(a) - k + 1, 0), np.uint64)
        for j in range(k if len(a) else 0):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ a[j : len(a) - k + 1 + j]
            h ^= h >> np.uint64(29)
        keys = {(r, int(((h * m + c) * np.uint64(0xD1B54A32D192ED03)).min())) for r, (m, c) in enumerate(odd)} if len(h) else {(-1, 0)}
        out.append(bool(keys & seen))
        seen |= keys
    return out


def _select(docs: list[set[bytes]], y: np.ndarray) -> list[str]:
    """Features whose share of toxic documents is significantly higher than of clean ones."""
    words: dict[bytes, list[float]] = {}
    for ws, label in zip(docs, y):
        for w in ws:
            words.setdefault(w, [0, 0])[label] += 1
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())

    def ratio(a, b):  # documents with the feature among toxic, among clean
        def part(k, n, p):
            return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

        return 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, (a + b) / (n0 + n1)) - part(b, n0, (a + b) / (n0 + n1)))

    # documents by n-gram: only grams of words that occur in enough toxic documents in sum
    toxic_grams: dict[str, int] = {}
    for w, (_, b) in words.items():
        if b:
            for f in features(w):
                toxic_grams[f] = toxic_grams.get(f, 0) + b
    alive = {f for f, n in toxic_grams.items() if n >= LEAST_DOCS}
    by_word = {w: [f for f in features(w) if f in alive] for w in words}
    a, b = dict.fromkeys(alive, 0), dict.fromkeys(alive, 0)
    for ws, label in zip(docs, y):
        tally = a if label else b
        for f in {f for w in ws for f in by_word[w]}:
            tally[f] += 1
    names = [f for f in alive if a[f] >= LEAST_DOCS and a[f] * n0 >= LEAST_LIFT * b[f] * n1]
    if not names:
        return []
    score = ratio(np.array([a[f] for f in names], float), np.array([b[f] for f in names], float))
    kept = sorted(((-s, f) for s, f in zip(score, names) if s >= LEAST_RATIO))[:MOST_FEATURES]
    return [f for _, f in kept]


def fit(texts: list[str], labels: list[int], rounds: int = 400, decay: float = 1e-4) -> Model:
    """Noisy-or likelihood by full-batch Adam. With one label only, or nothing telling, the
    model is constant: every sentence almost surely clean."""
    same: dict[bytes, bytes] = {}
    docs = [[same.setdefault(w, w) for w in _tokens(t)] for t in texts]
    fresh = [k for k, copy in enumerate(_near_copies(docs)) if not copy]
    docs, y = [docs[k] for k in fresh], np.array([labels[k] for k in fresh], int)
    if not len(y) or y.min() == y.max():
        return Model({}, -20.0)
    names = _select([set(d) - {_END} for d in docs], y)
    at = {f: k for k, f in enumerate(names)}
    word_features: dict[bytes, list[int]] = {}
    sent, feat, doc_of, n_sent = array("l"), array("l"), array("l"), 0
    for d, words in enumerate(docs):
        filled = False
        for w in [*words, _END]:
            if w == _END:
                if filled:
                    doc_of.append(d)
                    n_sent += 1
                filled = False
                continue
            filled = True
            if w not in word_features:
                word_features[w] = [at[f] for f in features(w) if f in at]
            for k in word_features[w]:
                sent.append(n_sent)
                feat.append(k)
    sent, feat, doc_of = np.array(sent, int), np.array(feat, int), np.array(doc_of, int)
    # toxic documents without a kept feature would only raise the bias, and clean scores with it
    told = np.isin(np.arange(len(y)), doc_of[sent]) | (y == 0)
    w, b = np.zeros(len(names)), -9.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    per_class = np.where(y == 1, 0.5 / max((y[told] == 1).sum(), 1), 0.5 / (y == 0).sum()) * told
    for t in range(1, rounds + 1):
        z = b + np.bincount(sent, w[feat], n_sent)
        soft = np.logaddexp(0, z)
        a = np.maximum(np.bincount(doc_of, soft, len(y)), 1e-12)
        pull = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(a, 500)), 1e-12), 1.0) * per_class
        g = pull[doc_of] * np.exp(z - soft)
        grad = np.append(np.bincount(feat, g[sent], len(names)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
        w, b = w - step[:-1], float(b - step[-1])
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents that aren't held out.

    The sample is bounded by ``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` and ``SAMPLE_BYTES``, drawn by
    a hash of the id. Labels other than 0 and 1 and null ids are ignored; a document with
    both labels counts as toxic; null texts and those over ``LONGEST_BYTES`` are ignored.
    """
    clean = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("g_id")).agg(F.max("toxic").alias("g_toxic"))
    drawn = [clean.where(F.col("g_toxic") == y).orderBy(F.xxhash64("g_id"), "g_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    slim = docs.select(F.col("doc_id").alias("g_id"), F.col("text").alias("g_text")).where(F.col("g_text").isNotNull())
    found = slim.join(ids, "g_id").withColumn("g_size", F.octet_length("g_text"))
    order = W.orderBy(F.xxhash64("g_id"), "g_id", "g_size", F.xxhash64("g_text")).rowsBetween(W.unboundedPreceding, 0)
    found = found.where(F.col("g_size") <= LONGEST_BYTES)
    within = found.withColumn("g_sum", F.sum("g_size").over(order)).where(F.col("g_sum") <= SAMPLE_BYTES)
    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    # in one task: SAMPLE_BYTES bound what it holds, and the driver gets the model alone
    fitted = within.select("g_id", "g_text", "g_toxic").coalesce(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else fit([], [])


def _memory(model, key: int) -> tuple[Model, Memory]:
    return held(("toxicity", key), lambda: (model.value, Memory(model.value.word, WORDS)))


def _sentence_scores(text: str, model: Model, memory: Memory) -> np.ndarray:
    words = _tokens(text)
    if not words:
        return np.zeros(0)
    memory[_END] = 0.0
    weights = np.array(memory.all(words))
    sentence = np.cumsum(np.fromiter((w == _END for w in words), bool, len(words)))
    filled = np.bincount(sentence) - 1 > 0
    filled[0] = words[0] != _END
    z = np.bincount(sentence, weights)[filled] + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``g_score``: 1 - product over sentences of (1 - p). Null and blank texts
    score 0; repeated rows are scored each; an empty table stays empty; other columns pass
    through untouched. One pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(repr(sorted(model.weights.items())) + repr(model.bias))
    at = docs.columns.index("text")

    def run(batches):
        model, memory = _memory(sent, key)
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                p = _sentence_scores(t, model, memory) if t else np.zeros(0)
                out.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum())) if len(p) else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], schema=b.schema.append(pa.field("g_score", pa.float64())))

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("g_score", DoubleType())]))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Offending sentences: ``doc_id, sentence`` (number from 0 among those with words),
    ``begin, end`` (code points), ``text, score``, for scores of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(repr(sorted(model.weights.items())) + repr(model.bias))

    def run(batches):
        model, memory = _memory(sent, key)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                begin, number = 0, 0
                for m in [*_MARKS.finditer(text or ""), None]:
                    end = m.start() if m else len(text or "")
                    p = _sentence_scores((text or "")[begin:end], model, memory)
                    if len(p):
                        if p[0] >= least:
                            rows.append((doc_id, number, begin, end, text[begin:end], float(p[0])))
                        number += 1
                    begin = m.end() if m else end
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "sentence", "begin", "end", "text", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sentence int, begin int, `end` int, text string, score double")
