"""Text operators against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import ann, lm_score, mixing, token_count, token_store, tokenizing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, score double, g_note string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ri", "to", "mel", "ka", "sun"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows_of(texts, ids=None):
    return [(i, t, "en", None if k % 7 == 3 else f"s{k % 4}", 1, 5, "x", 0.1, "y") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [sentence(rng, rng.randint(40, 120)) + "." for _ in range(30)]
    near = out[3].split()
    near[20] = "changed"
    out += [out[0], " ".join(near), None, "", "  \n ", "one", "two words", sentence(rng, 9000), "naïve Été <|endoftext|> 日本 x  y\n\n z"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    ids = list(range(len(texts) - 2)) + [None, 11]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokenizers_agree_on_all_characters():
    g, w = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = tokenizing.SpacedCounter(path, tokenizing.whole_tokens(path))
    encoder = tokenizing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    cases = [f"a{chr(c)} {chr(c)}{chr(c)}1{chr(c)}b  {chr(c)}\n{chr(c)}'s don{chr(c)}t" for c in [*range(1, 0x340), 0x2010, 0x2028, 0x20AC, 0x3000]]
    rng = random.Random(1)
    cases += ["".join(rng.choice(" \n\tab1'.éß") for _ in range(60)) for _ in range(300)]
    for t in cases:
        assert counter.count(t) == len(g.encode(t, add_special_tokens=False).ids), repr(t)
        ids = w.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def test_token_counts(spark, docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    g = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, path).collect())
    want = Counter()
    for (i, t, *_), _ in zip(docs.collect(), texts):
        n = len(g.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want and token_count.count_tokens(empty, path).isEmpty()


def test_token_store_round_trip(spark, docs, empty, tmp_path):
    path, tok = str(tmp_path / "store"), public_tokenizers.path("word_bpe_49k.json")
    w = Tokenizer.from_file(tok)
    digests = token_store.store_documents(docs.unionByName(docs.limit(3)), tok, path).orderBy("start").collect()
    rows = [(r.doc_id, w.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.unionByName(docs.limit(3)).collect()]
    assert Counter((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in rows) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests)
    assert [r.start for r in digests] == [sum(x.n_tokens for x in digests[:k]) for k in range(len(digests))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in digests]
    assert ids == sorted(ids)
    assert sorted(map(str, rows)) == sorted(str((r.doc_id, r.ids)) for r in token_store.read_documents(spark, path).collect())
    assert token_store.verify(spark, path)
    assert token_store.store_documents(empty, tok, str(tmp_path / "none")).count() == 0


def test_chunks_and_checksums():
    ids = np.random.default_rng(0).integers(0, 49000, 30000).astype("<u4")
    ends = token_store.chunk_ends(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.LONGEST and sizes[:-1].min() >= token_store.SHORTEST
    shifted = token_store.chunk_ends(np.concatenate([ids[:777], ids]))
    assert len({e - 777 for e in shifted} & set(ends)) > len(ends) // 2
    raw = ids.tobytes()
    parts = [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
    after = np.array([len(raw) - 4 * e for e in ends])
    assert np.bitwise_xor.reduce(token_store.shifted(np.array([zlib.crc32(p) for p in parts]), after)) == zlib.crc32(raw)


def test_mixing(docs, empty):
    plan = mixing.mix_plan(docs).collect()
    total = sum(r["size"] for r in plan)
    targets = {r.source: (r.target, r.source_size) for r in plan}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * n + 1e-9 for t, n in targets.values()) and all(r.copies <= 2 for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(empty).isEmpty() and mixing.mix(empty).isEmpty()


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    data, labels = [], []
    for k in range(240):
        s = [sentence(rng, 8) for _ in range(6)]
        bad = k % 3 == 0
        if bad:
            s[rng.randrange(6)] += f" grumbler{rng.choice(['s', 'ish', ''])}"
        data.append((k, ". ".join(s) + "."))
        labels.append((k, int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    scores = {r.doc_id: r.g_score for r in toxicity.score(df, model).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((scores[k] >= 0.5) == bool(labels[k][1]) for k in held) >= 0.95 * len(held)
    found = toxicity.locate(df, model).collect()
    assert found and all("grumbler" in r.text for r in found)
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and {r.g_score for r in odd.where("text IS NULL OR trim(text) = ''").collect()} == {0.0}
    assert toxicity.score(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))).isEmpty()


def test_toxicity_with_one_huge_labelled_text(spark):
    ids = [r.id for r in spark.range(300).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    rng = random.Random(6)
    data = [(k, f"{sentence(rng, 8)}. {'grumbler' if k % 2 else 'friend'} {sentence(rng, 4)}.") for k in ids[1:]] + [(ids[0], "calm words. " * 1_500_000)]
    labels = [(k, k % 2) for k in ids[1:]] + [(ids[0], 0)]
    model = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "you grumbler"), (2, "my friend")], "doc_id long, text string")
    assert {r.doc_id: r.g_score >= 0.5 for r in toxicity.score(probe, model).collect()} == {1: True, 2: False}


def test_language_model(docs, empty):
    rows = lm_score.score(docs).collect()
    data = [(r.doc_id, lm_score.tokens(r.text)) for r in docs.collect()]
    key = lambda i: "" if i is None else str(i)
    c = Counter(w for i, t in data if zlib.crc32(key(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((key(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in data)
    assert want == sorted((key(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows)
    assert all(r.score < 0 and r.train_tokens == n for r in rows)
    assert lm_score.score(empty).isEmpty()


def test_language_model_trains_on_every_token():
    share = np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)
    for k, text in enumerate(([0], [1, 0])):  # texts of one and two tokens
        texts = [np.array(text)] * 20
        ends = [lm_score._taught(lm_score.Params.start(share), share, texts, turn, 0)[0] for turn in range(lm_score.ROUNDS)]
        for c in range(k + 1):  # a class's bias goes up only where the class is a target
            assert any(e.b[text[c]] > np.log(share[0]) + 1e-6 for e in ends), text
    for n in range(1, 12):
        assert sorted(i for turn in range(lm_score.ROUNDS) for i in range(n)[lm_score._positions(n, turn)]) == list(range(n))


def test_language_model_against_plain_loops(spark, monkeypatch):
    """The score of every text, token by token, from the model; probabilities of all words sum to one."""
    monkeypatch.setattr(lm_score, "HEAD", 60)  # so that some words are joined by a shuffle
    monkeypatch.setattr(lm_score, "GROUP_TOKENS", 300)
    rng = random.Random(11)
    words = [sentence(rng, 1) for _ in range(90)]
    data = [(k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(90)], k=rng.randint(0, 40)))) for k in range(120)] + [(200, "unseen words"), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("held_out", lm_score.held_out(F.col("doc_id")))
    model = lm_score._counted(df.where("NOT held_out"))
    coded = lm_score._coded(df, model)
    params = lm_score._trained(coded, model)
    again = lm_score._trained(coded.orderBy(F.desc("uid")).repartition(3), model)
    assert (params.flat() == again.flat()).all()  # partitions and order don't matter
    got = {r.doc_id: r.score for r in lm_score._scored(coded, model, params, spark).collect()}
    count = {bytes(r.word): r.c for r in model.counts.collect()}
    own = {w: k for k, w in enumerate(model.vocabulary.words[: lm_score.WORD_CLASSES])}
    class_of = lambda w: own.get(w, lm_score.shape(w))
    members: dict = {}
    for w in count:
        members.setdefault(class_of(w), []).append(w)

    def softmax(one, two):
        s = params.context(np.array([one]), np.array([two]))[0] @ params.q.T + params.b
        e = np.exp(s.astype(float) - s.max())
        return e / e.sum()

    def within(w):
        k = class_of(w)
        if k < lm_score.WORD_CLASSES:
            return 1.0
        return (count.get(w, 0) + 1) / (sum(count[m] + 1 for m in members.get(k, [])) + 1)

    for i, text in data:
        before, total = [lm_score.CLASSES] * 2, 0.0
        for w in lm_score.tokens(text):
            total += math.log10(softmax(before[1], before[0])[class_of(w)] * within(w))
            before = [before[1], class_of(w)]
        assert got[i] == pytest.approx(total, abs=1e-3), text
    p = softmax(3, lm_score.WORD_CLASSES + 4)
    mass = sum(p[class_of(w)] * within(w) for w in count)
    unknown = sum(p[k] / (sum(count[m] + 1 for m in members.get(k, [])) + 1) for k in range(lm_score.WORD_CLASSES, lm_score.CLASSES))
    empty_words = sum(p[k] for k in range(lm_score.WORD_CLASSES) if k not in own.values())
    assert mass + unknown + empty_words == pytest.approx(1, abs=1e-6)


def test_language_model_is_normalised(spark):
    share = np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)
    p = lm_score.Params.start(share)
    z = lm_score._log_z(spark, p)
    s = (p.context(np.array([3]), np.array([lm_score.CLASSES])) @ p.q.T + p.b) / math.log(10) - z[3, lm_score.CLASSES]
    assert (10.0**s).sum() == pytest.approx(1, abs=1e-4)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[40:80] = v[40]
    data = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (None, v[0].tolist(), 0), (3, v[3].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    got = ann.search(ann.build_index(df, shard_rows=600), df.where("vec_id % 20 = 0"), k=10).collect()
    g = v.astype(float) @ v.astype(float).T
    hits = 0
    for q in range(0, 1500, 20):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(s == pytest.approx(g[q, i], rel=1e-12) for _, i, s in mine)
        true = sorted((k for k in range(1500) if k != q), key=lambda k: (-g[q, k], k))[:10]
        hits += len(set(true) & {m[1] for m in mine})
    assert hits >= 0.9 * 10 * 75
    none = df.where("vec_id = -1")
    assert ann.search(ann.build_index(none), none).isEmpty()
