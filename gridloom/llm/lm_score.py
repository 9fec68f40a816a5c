"""Language-model scores.

A log-bilinear model predicts the class of the next token from the classes of the two before
it: the context vectors, each through a matrix of its own, add up to a prediction that is
matched with every class's vector. It is trained in numpy by noise-contrastive estimation and
scores with normalised probabilities.

The most frequent words are classes of their own. Any other word belongs to a class by the
shape of its end, within which it has its add-one share of the words counted there; what is
left of a class goes to unknown words. So the probabilities of all tokens sum to one.

Counts cover every training document. Word counts are aggregated by Spark; the most frequent
``HEAD`` words, bounded by that number, are broadcast, all others are joined by a shuffle.
Training goes over every token of every document as well: in each of ``ROUNDS`` rounds each
group of texts takes steps from common parameters on one of ``ROUNDS`` positions, other ones than in
the rounds before, then the parameters are averaged. Texts are tokenised twice, to count words
and to write them as classes, which training and scoring read.
"""

from __future__ import annotations

import dataclasses
import math
import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import held, lean, table

HEAD = 200_000
WORD_CLASSES, SHAPES = 512, 256
CLASSES = WORD_CLASSES + SHAPES
DIM, NOISE, BATCH = 24, 96, 512
ROUNDS, RATE = 2, 0.3
#: Tokens of a group of texts that take steps one after the other, about; parameter sets that are averaged at once.
GROUP_TOKENS, FAN = 4_000_000, 64
#: Distinct words that a worker counts before it passes the counts on.
FLUSH = 300_000
_PUNCTUATION = b".,;:!?\"'()[]{}*-|%&$#"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 of 7; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end, which is written as the empty word."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(b"")
    return out


def shape(word: bytes) -> int:
    """Class of a word by its last letters, the mark after them and its last special letter."""
    stem = word.rstrip(_PUNCTUATION)
    high = [b for b in stem[-6:] if b > 127]
    return WORD_CLASSES + zlib.crc32(stem[-2:] + b"|" + word[len(stem) :][:1] + bytes(high[-1:])) % SHAPES


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over all texts of ``docs``."""

    def run(batches):
        tally: Counter = Counter()

        def flush():
            words, ns = list(tally), list(tally.values())
            tally.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ns, pa.int64())], names=["word", "c"])

        for b in batches:
            for t in b.column(0):
                tally.update(tokens(t.as_py()))
                if len(tally) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Params:
    """Input and output vectors, biases, the two context matrices."""

    def __init__(self, r, q, b, c):
        self.r, self.q, self.b, self.c = r, q, b, c

    @classmethod
    def start(cls, share: np.ndarray):
        rng = np.random.default_rng(7)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        eye = np.stack([np.eye(DIM), np.eye(DIM)]).astype(np.float32)
        return cls(small(CLASSES + 1, DIM), small(CLASSES, DIM), np.log(share).astype(np.float32), eye * np.float32(0.5))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)])

    @classmethod
    def of(cls, flat: np.ndarray):
        out, at = [], 0
        for s in ((CLASSES + 1, DIM), (CLASSES, DIM), (CLASSES,), (2, DIM, DIM)):
            n = math.prod(s)
            out.append(flat[at : at + n].reshape(s).astype(np.float32))
            at += n
        return cls(*out)

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Prediction from the class before (``one``) and the one before that."""
        return self.r[one] @ self.c[0] + self.r[two] @ self.c[1]


class Trainer:
    """Noise-contrastive estimation with steps scaled by past gradients (Adagrad)."""

    def __init__(self, params: Params, share: np.ndarray, seed: int):
        self.p, self.rng = params, np.random.default_rng(seed)
        self.cumulative = np.cumsum(share)
        self.log_noise = np.log(share * NOISE).astype(np.float32)
        self.past = [np.full_like(x, 1e-2) for x in (params.r, params.q, params.b, params.c)]

    def _rows(self, k: int, target: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        g = np.add.reduceat(grad[order], first, axis=0)
        at = rows[order][first]
        self.past[k][at] += g * g
        target[at] -= RATE * g / np.sqrt(self.past[k][at])

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
        r1, r2 = p.r[one], p.r[two]
        ctx = r1 @ p.c[0] + r2 @ p.c[1]
        own = np.einsum("bd,bd->b", ctx, p.q[word]) + p.b[word] - self.log_noise[word]
        other = ctx @ p.q[noise].T + p.b[noise] - self.log_noise[noise]
        d_own = (1 / (1 + np.exp(-np.clip(own, -30, 30))) - 1).astype(np.float32) / len(word)
        d_other = (1 / (1 + np.exp(-np.clip(other, -30, 30)))).astype(np.float32) / len(word)
        d_ctx = d_own[:, None] * p.q[word] + d_other @ p.q[noise]
        rows = np.concatenate([word, noise])
        grads = np.concatenate([d_own[:, None] * ctx, d_other.T @ ctx])
        bias = np.concatenate([d_own, d_other.sum(0)])
        d_c = np.stack([r1.T @ d_ctx, r2.T @ d_ctx])
        d_r = np.concatenate([d_ctx @ p.c[0].T, d_ctx @ p.c[1].T])
        self._rows(1, p.q, rows, grads)
        self._rows(2, p.b, rows, bias)
        self._rows(0, p.r, np.concatenate([one, two]), d_r)
        self.past[3] += d_c * d_c
        p.c -= RATE * d_c / np.sqrt(self.past[3])


def _contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before each token and the one before that; ``CLASSES`` stands for the text's start."""
    one = np.concatenate([[CLASSES], classes[:-1]])
    return one, np.concatenate([[CLASSES], one[:-1]])


class Vocabulary:
    """Head words with their counts; the first ``WORD_CLASSES`` of them are classes."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, counts

    def open(self):
        """Index by word; class and log10(count + 1) by index, index -1 for all other words."""
        at = {w: k for k, w in enumerate(self.words)}
        cls = np.array([k if k < WORD_CLASSES else shape(w) for k, w in enumerate(self.words)] + [-1], np.int32)
        return at, cls, np.log10(np.array([*self.counts, 0], float) + 1)


def _classes(toks: list[bytes], at: dict, cls: np.ndarray):
    index = np.fromiter(map(at.get, toks, repeat(-1)), np.int64, len(toks))
    classes = cls[index]
    tail = [toks[k] for k in np.flatnonzero(index < 0).tolist()]
    if tail:
        classes[index < 0] = [shape(w) for w in tail]
    return index, classes, tail


def _positions(n: int, turn: int) -> slice:
    """Positions of a text of ``n`` tokens that train in a round; over all rounds each is taken once."""
    return slice((turn + n) % ROUNDS, None, ROUNDS)


def _taught(params: Params, share: np.ndarray, texts: list[np.ndarray], turn: int, group: int) -> tuple[Params, int]:
    """Parameters after steps on a group's texts, given as classes, and the number of positions."""
    trainer = Trainer(params, share, 1_000_003 * turn + group)
    n = 0
    for lo in range(0, len(texts), 256):
        waiting = []
        for classes in texts[lo : lo + 256]:
            one, two = _contexts(classes)
            pick = _positions(len(classes), turn)
            waiting.append((one[pick], two[pick], classes[pick]))
        one, two, word = (np.concatenate(x) for x in zip(*waiting))
        mixed = trainer.rng.permutation(len(word))
        for at in range(0, len(mixed), BATCH):
            k = mixed[at : at + BATCH]
            trainer.step(one[k], two[k], word[k])
        n += len(word)
    return trainer.p, n


def _train_round(coded: DataFrame, params: Params, share: np.ndarray, turn: int, groups: int) -> Params:
    """Mean of what the groups of ``coded`` (``group, place, classes``) make of the parameters.

    Groups and the order in them are by hashes of the texts, so that partitions don't matter.
    """
    begin = coded.sparkSession.sparkContext.broadcast((params.flat(), share))

    def teach(t):
        flat, share_ = begin.value
        t = t.sort_by([("place", "ascending"), ("classes", "ascending")])
        group = t.column("group")[0].as_py()
        p, n = _taught(Params.of(flat.copy()), share_, [np.frombuffer(c.as_py(), "<i2").astype(np.int64) for c in t.column("classes")], turn, group)
        return pa.table({"group": pa.array([group], pa.int32()), "n": pa.array([float(n)]), "flat": pa.array([p.flat().astype("<f4").tobytes()], pa.binary())})

    def mean(t):
        t = t.sort_by("group")
        total, weight = 0.0, 0.0
        for n, flat in zip(t.column("n").to_pylist(), t.column("flat").to_pylist()):
            total = total + n * np.frombuffer(flat, "<f4").astype(float)
            weight += n
        flat = (total / weight).astype("<f4").tobytes() if weight else t.column("flat")[0].as_py()
        return pa.table({"group": pa.array([t.column("group")[0].as_py() // FAN], pa.int32()), "n": pa.array([weight]), "flat": pa.array([flat], pa.binary())})

    made = "group int, n double, flat binary"
    means = coded.groupBy("group").applyInArrow(teach, made)
    while groups > 1:  # so that no task and not the driver sees more than FAN parameter sets
        means = means.groupBy(F.floor(F.col("group") / FAN).alias("above")).applyInArrow(mean, made)
        groups = -(-groups // FAN)
    rows = means.collect()  # one at most
    return Params.of(np.frombuffer(rows[0].flat, "<f4").astype(float)) if rows else params


def _log_z(spark, params: Params) -> np.ndarray:
    """log10 of the sum over classes, for every pair of context classes, as batched products."""
    held = spark.sparkContext.broadcast(params.flat())

    def run(batches):
        p = Params.of(held.value)
        two = np.arange(CLASSES + 1)
        for b in batches:
            for one in b.column(0).to_pylist():
                s = p.context(np.full(CLASSES + 1, one), two) @ p.q.T + p.b
                top = s.max(axis=1)
                z = (np.log(np.exp(s - top[:, None]).sum(axis=1)) + top) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([z.astype("<f8").tobytes()], pa.binary())], names=["one", "z"])

    rows = spark.range(CLASSES + 1).mapInArrow(run, "one long, z binary").collect()  # fixed by CLASSES
    out = np.zeros((CLASSES + 1, CLASSES + 1))
    for r in rows:
        out[r.one] = np.frombuffer(r.z, "<f8")
    return out


@dataclasses.dataclass
class Model:
    """``vocabulary`` holds the words counted more than ``least`` times; ``room`` is log10 of the
    counts, words and one unknown word of each class of shapes; N and V are ``total, distinct``."""

    params: Params
    vocabulary: Vocabulary
    room: np.ndarray
    share: np.ndarray
    counts: DataFrame
    total: int
    distinct: int
    least: int


def _counted(training: DataFrame) -> Model:
    """All of the model but trained vectors."""
    counts = table(count_words(training), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # words counted more than ``least`` times are at most HEAD; distinct counts are few, their sum being at most N
    above = F.sum("n").over(W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, 0))
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("above", above)
    least = by_count.where(F.col("above") > HEAD).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    head = sorted(counts.where(F.col("c") > least).collect(), key=lambda r: (-r.c, bytes(r.word)))  # bounded by HEAD
    vocabulary = Vocabulary([bytes(r.word) for r in head], [r.c for r in head])
    del head

    def shapes(batches):
        for b in batches:
            k = np.array([shape(w) for w in b.column(0).to_pylist()], np.int64) - WORD_CLASSES
            c = b.column(1).to_numpy()
            n, v = np.bincount(k, c, SHAPES), np.bincount(k, minlength=SHAPES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(n), pa.array(v, pa.int64())], names=["shape", "n", "v"])

    n_words = min(WORD_CLASSES, len(vocabulary.words))
    by_shape = counts.mapInArrow(shapes, "shape int, n double, v long").groupBy("shape").agg(F.sum("n"), F.sum("v")).collect()  # SHAPES rows
    n_shape, v_shape = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, n, v in by_shape:
        n_shape[s], v_shape[s] = n, v
    for k in range(n_words):  # words with a class of their own leave the shapes
        s = shape(vocabulary.words[k]) - WORD_CLASSES
        n_shape[s] -= vocabulary.counts[k]
        v_shape[s] -= 1
    share = np.ones(CLASSES)
    share[:n_words] += vocabulary.counts[:n_words]
    share[WORD_CLASSES:] += n_shape
    share /= share.sum()
    return Model(Params.start(share), vocabulary, np.log10(n_shape + v_shape + 1), share, counts, total, distinct, least)


def _coded(docs: DataFrame, model: Model) -> DataFrame:
    """Each row as the classes of its tokens, with what its score has besides the classes'
    probabilities: ``rest`` within classes, ``head_log`` of the base score; ``tail`` are the words
    that the vocabulary doesn't hold."""
    sent = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.room))
    key = f"{uuid.uuid4()}"

    def run(batches):
        at, cls, logs, room = held(("vocabulary", key), lambda: (*sent.value[0].open(), sent.value[1]))
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cols: list[list] = [[] for _ in range(7)]
                for text in part.column("text").to_pylist():
                    index, classes, tail = _classes(tokens(text), at, cls)
                    shaped = classes >= WORD_CLASSES
                    in_head = logs[index]
                    rest = in_head[shaped].sum() - room[classes[shaped] - WORD_CLASSES].sum()
                    for c, x in zip(cols, (uid, len(index), len(index) - len(tail), float(in_head.sum()), float(rest), classes.astype("<i2").tobytes(), tail)):
                        c.append(x)
                    uid += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                    names=["doc_id", "held_out", "uid", "n_tokens", "known", "head_log", "rest", "classes", "tail"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, uid long, n_tokens long, known long, head_log double, rest double, classes binary, tail array<binary>"
    return table(docs.mapInArrow(lean(run), schema), "coded-texts")


def _trained(coded: DataFrame, model: Model) -> Params:
    groups = max(1, -(-model.total // GROUP_TOKENS))
    texts = coded.where("NOT held_out").select(F.pmod(F.xxhash64("classes", F.lit("group")), F.lit(groups)).cast("int").alias("group"), F.xxhash64("classes").alias("place"), "classes")
    params = model.params
    for turn in range(ROUNDS):
        params = _train_round(texts, params, model.share, turn, groups)
    return params


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from rows that aren't held out. A null text is empty and has one token, its end;
    repeated rows count and are scored each; with no training row, N and V are 0 and every
    token has base log10(1); an empty table gives an empty table; other columns are ignored.
    Neither partitions nor the order of rows change a result.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = _counted(slim.where("NOT held_out"))
    coded = _coded(slim, model)
    return _scored(coded, model, _trained(coded, model), spark)


def _scored(coded: DataFrame, model: Model, params: Params, spark) -> DataFrame:
    sent = spark.sparkContext.broadcast((params.flat(), _log_z(spark, params)))

    def run(batches):
        flat, log_z = sent.value
        p = Params.of(flat)
        for b in batches:
            lm = []
            for raw in b.column("classes"):
                classes = np.frombuffer(raw.as_py(), "<i2").astype(np.int64)
                one, two = _contexts(classes)
                own = (np.einsum("bd,bd->b", p.context(one, two), p.q[classes]) + p.b[classes]).astype(float) / math.log(10)
                lm.append(float((own - log_z[one, two]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:-1]] + [pa.array(lm, pa.float64())], names=names)

    names = ["doc_id", "held_out", "uid", "n_tokens", "known", "head_log", "rest", "lm"]
    id_type = coded.schema["doc_id"].dataType.simpleString()
    scored = coded.select(*names[:-1], "classes").mapInArrow(lean(run), f"doc_id {id_type}, held_out boolean, uid long, n_tokens long, known long, head_log double, rest double, lm double")
    if model.distinct > len(model.vocabulary.words):
        scored = table(scored, "lm-scores")
        rare = model.counts.where(F.col("c") <= model.least)
        tail = coded.select("uid", F.explode("tail").alias("word")).join(rare, "word")
        sums = tail.groupBy("uid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1)).alias("tail_log"))
        scored = scored.join(sums, "uid", "left")
    else:
        scored = scored.withColumns({"tail_known": F.lit(0), "tail_log": F.lit(0.0)})
    known = F.col("known") + F.coalesce("tail_known", F.lit(0))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * math.log10(model.total + model.distinct + 1)).alias("base_score"),
        (F.col("lm") + F.col("rest") + tail_log).alias("score"),
    )
