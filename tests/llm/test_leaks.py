"""Benchmark leaks against brute force over all windows, fingerprints against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam

SCHEMA = "doc_id long, text string, t long, h string, win long, item_id long, n_words int"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ri", "to", "mel", "ka", "sun"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def grams(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def best_window(doc, item):
    """Similarity and start of the best window, by looking at all of them."""
    a, b = doc.lower().split(), item.lower().split()
    want = grams(b)
    best = (0.0, 0)
    for start in range(max(1, len(a) - len(b) + 1)):
        got = grams(a[start : start + len(b)]) if len(b) >= 5 or len(a) >= len(b) else Counter()
        s = sum((got & want).values()) / max(1, sum((got | want).values()))
        best = max(best, (s, -start))
    return best[0], -best[1]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    items = [sentence(rng, n) for n in (1, 2, 3, 4, 5, 6, 9, 15, 30, 60, 60, 90, 90, 300)]
    items[5] = "ba ba ba ba ba ba"
    docs = []
    for item in items:
        w = item.split()
        for edits in range(7):
            v = list(w)
            for _ in range(edits):  # near one end, so that all similarities come up
                v[rng.randrange(max(1, len(v) // 4)) if rng.random() < 0.7 else rng.randrange(len(v))] = sentence(rng, 1)
            docs.append(f"{sentence(rng, rng.randint(0, 40))} {' '.join(v).upper() if edits % 2 else ' '.join(v)} {sentence(rng, rng.randint(0, 40))}".strip())
        docs += [" ".join(w[len(w) // 8 :]), " ".join(w[: len(w) // 2] + w[: len(w) // 2])]
    docs += ["", " \n ", None, "ba ba ba ba ba ba ba ba", sentence(rng, 12_000)]
    return items, docs


def test_leaks_are_those_of_all_windows(spark, made):
    items, docs = made
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, " ")], "item_id long, text string")
    df = spark.createDataFrame([(k, t, 1, "x", 2, 3, 4) for k, t in enumerate(docs)], SCHEMA)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in decontam.leaks(df, bench).collect()}
    want = {}
    for d, doc in enumerate(docs[:-1]):
        for i, item in enumerate(items):
            s, start = best_window(doc or "", item)
            if s >= 0.8:
                want[d, i] = (round(s, 9), start)
    found = {k: v for k, v in got.items() if k[0] != len(docs) - 1}
    assert {k: s for k, (s, _) in found.items()} == {k: s for k, (s, _) in want.items()}
    for (d, i), (s, start) in found.items():  # of windows alike it may be a later one, which starts at a shared shingle
        n = len(items[i].split())
        assert round(best_window(" ".join(docs[d].split()[start : start + n]), items[i])[0], 9) == s and start >= want[d, i][1]
    assert sum(0.8 <= s < 0.95 for s, _ in want.values()) >= 8
    left = {r.doc_id for r in decontam.decontaminate(df, bench).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in got}


def test_index_finds_all_within_the_radius(spark):
    rng = random.Random(5)

    def near(f, bits):
        return f ^ sum(1 << k for k in rng.sample(range(128), bits))

    def halves(f):
        return [x - (1 << 64) if x >> 63 else x for x in (f & (1 << 64) - 1, f >> 64)]

    centres = [rng.getrandbits(128) for _ in range(40)]
    windows = [(1000 * k + n, 30, near(c, n)) for k, c in enumerate(centres) for n in (0, 5, 19, 28, 31, 32, 33, 36)]
    frame = lambda rows, name: spark.createDataFrame([(i, n, *halves(f)) for i, n, f in rows], f"{name} long, n_words int, f0 long, f1 long")
    found = decontam.within_radius(frame(windows, "win"), frame([(k, 30, c) for k, c in enumerate(centres)], "item"))
    got = {(r.win, r.item): r.distance for r in found.collect()}
    want = {(i, k): (f ^ c).bit_count() for i, _, f in windows for k, c in enumerate(centres) if (f ^ c).bit_count() <= decontam.RADIUS}
    assert got == want and len(want) >= 240


def test_fingerprints(spark):
    rows = [(k, [random.Random(k * 9 + j).getrandbits(63) for j in range(n)]) for k, n in enumerate((1, 2, 7, 40))]
    for r in decontam.with_fingerprints(spark.createDataFrame(rows, "k long, h array<bigint>")).collect():
        want = sum(1 << k for k in range(64) if 2 * sum(s >> k & 1 for s in r.h) > len(r.h))
        assert r.f0 & (1 << 64) - 1 == want


def test_nulls_repeats_and_empty_tables(spark):
    rng = random.Random(2)
    item = sentence(rng, 20)
    data = [(None, item), (4, f"x {item}"), (4, f"x {item}"), (4, f"x {item} {item}"), (5, sentence(rng, 30))]
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in data], SCHEMA)
    bench = spark.createDataFrame([(1, item), (None, item), (1, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start) for r in decontam.leaks(df, bench).collect()), key=str)
    assert got == sorted([(d, i, s) for d, s in ((None, 0), (4, 1)) for i in (None, 1)], key=str)
    assert [r.doc_id for r in decontam.decontaminate(df, bench).collect()] == [5]
    assert decontam.decontaminate(df, bench).columns == df.columns
    assert decontam.leaks(df.limit(0), bench).isEmpty() and decontam.leaks(df, bench.limit(0)).isEmpty()
    assert decontam.decontaminate(df, bench.limit(0)).count() == 5
