"""Near duplicates against brute force, with nulls, empty texts, repeats, ties and clashing columns."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import omh_dedup

SCHEMA = "doc_id long, text string, key long, h string, root string, t int"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ri", "to", "mel", "ka", "sun"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, sentence(rng, 1)), lambda: out.pop(k), lambda: out.insert(k, sentence(rng, 1))])()
    return out


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 14))] if rng.random() < 0.4 else list(a)
        for _ in range(rng.randint(0, 4)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        d, most = plain_distance(a, b), rng.randint(0, 8)
        assert omh_dedup.edit_distance(a, b, most) == (d if d <= most else None), (a, b, most)


def test_bins_bound_the_distance_from_below():
    rng = random.Random(2)
    for _ in range(200):
        a = sentence(rng, rng.randint(1, 60)).split()
        b = edited(rng, a, min(len(a) - 1, rng.randint(0, 9))) or a
        x, y = (omh_dedup.bins(omh_dedup.word_hashes(" ".join(w).encode())).astype(int) for w in (a, b))
        assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum()) <= plain_distance(a, b)


@pytest.mark.parametrize("n", (5, 10, 30, 55, 100, 300))
def test_recall_of_sketches(n):
    """Over scattered edits and over every fifth word changed, in each band of similarity."""
    rng = random.Random(n)
    for least in (0.8, 0.85, 0.9, 0.95):
        met = pairs = 0
        for turn in range(160):
            a = sentence(rng, n).split()
            changes = int((1 - least) * n + 1e-9)
            b = edited(rng, a, changes)
            if turn % 4 == 0:
                b = list(a)
                for k in range(changes):
                    b[int((k + 0.5) * n / changes)] = "changed" + str(k)
            x, y = " ".join(a).encode(), " ".join(b).encode()
            if omh_dedup.similarity(x, y) is None:
                continue
            pairs += 1
            met += any(p == q for p, q in zip(*(omh_dedup.sketches(omh_dedup.word_hashes(z)) for z in (x, y))))
        assert pairs > 100 and met >= 0.97 * pairs, (n, least, met, pairs)


def brute_classes(texts):
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    words = [(t or "").split() for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        longer = max(len(words[i]), len(words[j]))
        if abs(len(words[i]) - len(words[j])) <= 0.2 * longer + 1e-9 and plain_distance(words[i], words[j]) <= 0.2 * longer + 1e-9:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = [None, "", " \n ", "one", "two words", "two words"]
    for n in (4, 5, 12, 30, 40, 60):
        for _ in range(4):
            a = sentence(rng, n).split()
            texts += [" ".join(x) for x in (a, edited(rng, a, max(1, n // 10)), edited(rng, a, max(1, n // 5)), edited(rng, a, n // 2 + 1))]
    shared = sentence(rng, 20)
    texts += [f"{sentence(rng, 40)} {shared}" for _ in range(12)]  # a passage in common, no near copies
    return [(k, t, 1, "x", "y", 2) for k, t in enumerate(texts)]


def test_classes_are_those_of_all_pairs(spark, rows, monkeypatch):
    want = brute_classes([r[1] for r in rows])
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (2048, 3):  # buckets in one block, and in several
        monkeypatch.setattr(omh_dedup, "BLOCK_ROWS", block)
        got = {r.doc_id: r.class_id for r in omh_dedup.classes(df).collect()}
        assert len(got) == len(rows)
        wrong = [k for k, w in enumerate(want) if got[k] != w]
        assert not wrong, wrong
    kept = omh_dedup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_nulls_repeats_and_empty_tables(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    data = [(None, a), (None, a), (None, b), (7, b), (None, c), (5, c + " more"), (5, c + " more"), (5, a + " end")]
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in data], SCHEMA)
    got = sorted(((r.doc_id, r.class_id) for r in omh_dedup.classes(df).collect()), key=str)
    assert got == sorted([(None, 5), (None, 5), (None, 7), (7, 7), (None, 5), (5, 5), (5, 5), (5, 5)], key=str)
    assert sorted((r.doc_id, len(r.text.split())) for r in omh_dedup.deduplicate(df).collect()) == [(5, 41), (5, 41), (7, 40)]
    nulls = spark.createDataFrame([(None, t, 1, "x", "y", 2) for t in (a, b, b, c)], SCHEMA)
    assert sorted(r.text for r in omh_dedup.deduplicate(nulls).collect()) == sorted([a, b, c])
    none = df.limit(0)
    assert omh_dedup.classes(none).isEmpty() and omh_dedup.deduplicate(none).isEmpty()


def test_links_between_texts_of_different_leaders(spark):
    """Drifting versions in one bucket: 0.84 from one to the next, 0.68 to the one after."""
    rng = random.Random(21)
    data = []
    for chain in range(24):
        w = sentence(rng, 132).split()
        data += [(4 * chain + k, " ".join(w[8 * k : 8 * k + 100]), chain) for k in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string, chain long")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts = [omh_dedup.bins(omh_dedup.word_hashes(x.as_py().encode())).tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("t"), b.column("h"), pa.array(counts, pa.binary()), b.column("chain")], names=["t", "h", "bins", "chain"])

    hashed = df.select(F.col("doc_id").alias("t"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), "text", "chain")
    one_bucket = hashed.mapInArrow(run, "t long, h binary, bins binary, chain long").select("t", "h", F.lit(100).alias("words"), "bins", F.array("chain").alias("keys"))
    roots = omh_dedup.links(df, one_bucket).collect()
    assert len(roots) == 96 and {r.t: r.root for r in roots} == {k: k // 4 * 4 for k in range(96)}


def test_components_of_loops_and_repeats(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (9, 4), (4, 7), (7, 9), (20, 19), (19, 18), (18, 17), (17, 16)], "a_root long, b_root long")
    assert {r.t: r.root for r in omh_dedup.components(edges).collect()} == {1: 1, 2: 1, 3: 3, 9: 4, 4: 4, 7: 4, 20: 16, 19: 16, 18: 16, 17: 16, 16: 16}
    assert omh_dedup.components(edges.limit(0)).isEmpty()
