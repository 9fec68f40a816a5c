"""Near-duplicate documents by order MinHash.

A document is the sequence of its ``SHINGLE``-word shingles, each labelled with how often it
occurred before. Each of ``BANDS`` sketches takes the ``KEPT`` labelled shingles of least hash
and keeps them in text order, so equal sketches mean that the same shingles came in the same
order. Texts that share a sketch are candidates; the edit distance of their words, by a
bit-parallel alignment in the band that the threshold allows, decides. With every fifth word
changed (similarity 0.8) two texts share a quarter of their shingles, so a sketch with
probability 0.06 and one of all with 0.99. In short texts a few edits hit nearly all shingles,
so texts that can be linked to one of up to ``SHORT`` words have ``SHORT_BANDS`` sketches of
``SHORT_KEPT`` single words besides.

Exact copies are one text from the start. In each of ``LEADER_ROUNDS`` rounds one text of a
bucket leads, and each text is aligned with that leader of another class which leads most of
its buckets: an alignment a text and round. What is left are buckets in which texts of
different classes meet. Their members are compared in blocks by word counts in ``BINS`` bins,
which bound the edit distance from below, so this drops no pair that is similar enough; the
pairs that pass are aligned. No candidate that could join two classes is left out; pairs
within a class aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, lean, small_enough, table

SHINGLE, BANDS, KEPT, LEAST = 3, 80, 2, 0.8
SHORT, SHORT_BANDS, SHORT_KEPT = 50, 24, 3
LEADER_ROUNDS, BINS = 2, 64
#: Rows of a bucket that meet in a block; a larger bucket is a block for each pair of its parts.
BLOCK_ROWS = 2048
#: Keys up to this many are broadcast (about 16 bytes each), more are shuffled.
BROADCAST_KEYS = 200_000

_RNG = np.random.default_rng(10)
_MULTIPLY = _RNG.integers(0, 2**63, BANDS + SHORT_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS + SHORT_BANDS, dtype=np.uint64)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**64 - 1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word of a text in UTF-8, without a Python object per word."""
    b = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[b]
    if not solid.any():
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    b, solid, starts = b[starts[0] :], solid[starts[0] :], starts - starts[0]
    at = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    powers = np.cumprod(np.full(int(at.max()) + 1, _P, np.uint64))
    return _mix(np.add.reduceat(np.where(solid, _BYTE[b] * powers[at], np.uint64(0)), starts))


def _labelled(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles of ``k`` words, each with the number of its earlier occurrences."""
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = _mix(h * _P + w[j : j + n])
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    place = np.arange(n)
    earlier = np.empty(n, np.uint64)
    earlier[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    # also where nothing repeats: a near copy in which something does must have the same hashes
    return _mix(h + earlier * np.uint64(0xD1B54A32D192ED03))


def _keys(h: np.ndarray, lo: int, hi: int, kept: int) -> np.ndarray:
    """A key for each of the bands from ``lo`` to ``hi``: its ``kept`` least shingles in text order."""
    most = min(kept, len(h))
    picked = np.empty((hi - lo, most), np.int64)
    step = max(1, (1 << 15) // len(h))  # so that a block of orders stays in the cache
    for at in range(lo, hi, step):
        end = min(hi, at + step)
        order = (h[None, :] ^ _ADD[at:end, None]) * _MULTIPLY[at:end, None]
        rows = np.arange(end - at)
        for k in range(most):
            least = order.argmin(axis=1)
            picked[at - lo : end - lo, k] = least
            order[rows, least] = _LAST
    picked.sort(axis=1)  # back in text order
    keys = np.arange(lo, hi, dtype=np.uint64)
    for x in h[picked].T:
        keys = _mix(keys * _P + x)
    return keys.view(np.int64)


def sketches(w: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of the hashes of a text's words, and ``SHORT_BANDS`` more of a short text;
    a text without words has the keys of an empty sequence."""
    if not len(w):
        return np.zeros(BANDS, np.int64)
    keys = _keys(_labelled(w, min(SHINGLE, len(w))), 0, BANDS, KEPT)
    if len(w) * LEAST > SHORT:
        return keys
    return np.concatenate([keys, _keys(_labelled(w, 1), BANDS, BANDS + SHORT_BANDS, SHORT_KEPT)])


def bins(w: np.ndarray) -> np.ndarray:
    """Numbers of words by their hash, in ``BINS`` bins, at most 65,535 each."""
    return np.minimum(np.bincount((w >> np.uint64(58)).astype(np.int64), minlength=BINS), 65_535).astype("<u2")


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences, or None if it is more than ``most``.

    Column by column, the steps between neighbouring cells within ``most`` of the diagonal are
    the bits of two integers, so a column takes a few operations on ``2 * most + 1`` bits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    lo = end = 0
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    while end < len(a) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    rows, gap = len(a), len(b) - len(a)
    if not rows:
        return gap
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i + most
    band, middle = (1 << 2 * most + 1) - 1, 1 << most
    up, down, cost = band ^ middle - 1, 0, 0  # cells one above, one below the cell over them
    for j, w in enumerate(b):
        same = places.get(w, 0) >> j & band
        level = ((same & up) + up ^ up | same | down) & band  # as the cell diagonally before
        right = down | band & ~(level | up)
        left = level & up
        if j < rows:
            cost += not level & middle
            if cost - gap > most:
                return None
        else:
            cell = 1 << rows - j - 1 + most
            cost += bool(right & cell) - bool(left & cell)
        level >>= 1  # the band of the next column lies a row lower
        up, down = left | band & ~(level | right), level & right
    return cost if cost <= most else None


def similarity(a: bytes, b: bytes, least: float = LEAST) -> float | None:
    """1 - edit distance of the words / words of the longer text; None if below ``least``."""
    x, y = a.split(), b.split()
    longer = max(len(x), len(y))
    if not longer:
        return 1.0
    d = edit_distance(x, y, int((1 - least) * longer + 1e-9))
    return None if d is None else 1 - d / longer


def _raw():
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, h, words, bins, keys`` of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _raw().alias("raw"), F.unhex(F.md5(_raw())).alias("h"))

    def run(batches):
        for b in batches:
            hashes = [word_hashes(r.as_py()) for r in b.column("raw")]
            cols = [pa.array([len(w) for w in hashes], pa.int32()), pa.array([bins(w).tobytes() for w in hashes], pa.binary()), pa.array([sketches(w) for w in hashes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *cols], names=["doc_id", "h", "words", "bins", "keys"])

    return slim.mapInArrow(lean(run), "doc_id long, h binary, words int, bins binary, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """``a_root, b_root`` of those pairs ``a, b, a_root, b_root`` of text numbers that are similar
    enough; of pairs that would join the same classes a task may leave out all after the first."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct().join(texts.select("t", "h"), "t"))
    side = F.broadcast(wanted) if small_enough(wanted, BROADCAST_KEYS) else wanted
    raw = table(docs.select(_raw().alias("raw")).withColumn("h", F.unhex(F.md5("raw"))).join(side, "h").dropDuplicates(["t"]).select("t", "raw"), "texts")

    def run(batches):
        above: dict = {}

        def top(x):
            while x in above:
                x = above[x]
            return x

        for b in batches:
            out = []
            for x, y, p, q in zip(*(b.column(c) for c in ("x", "y", "a_root", "b_root"))):
                p, q = p.as_py(), q.as_py()
                here, there = top(p), top(q)
                if here != there and similarity(x.as_py(), y.as_py(), least) is not None:
                    above[here] = there
                    out.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a_root", "b_root"])

    # a leader of a third of all texts: its side is one row, the other's is split by adaptive skew joins
    both = pairs.join(raw.select(F.col("t").alias("b"), F.col("raw").alias("y")), "b").join(raw.select(F.col("t").alias("a"), F.col("raw").alias("x")), "a")
    return both.select("a_root", "b_root", "x", "y").mapInArrow(lean(run), "a_root long, b_root long")


def _meetings(least: float):
    """Pairs of a block ``key, part, other, t, root, words, bins, own``, sorted by the first three,
    that differ in root and that words and bins don't rule out."""

    def close(rows):
        t, root, words, raw, own = zip(*rows)
        t, root, words, own = (np.array(x) for x in (t, root, words, own))
        counts = np.frombuffer(b"".join(raw), "<u2").reshape(len(t), BINS).astype(np.int32)
        found = []
        for k in range(len(t) - 1):
            r = slice(k + 1, None)
            longer = np.maximum(words[k], words[r])
            good = np.flatnonzero((root[r] != root[k]) & (np.minimum(words[k], words[r]) >= least * longer - 1e-9) & ((own[r] != own[k]) | (own[k] == 2))) + k + 1
            if not len(good):
                continue
            d = counts[good] - counts[k]
            bound = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))
            good = good[bound <= (1 - least) * np.maximum(words[k], words[good]) + 1e-9]
            found += [(t[k], t[g], root[k], root[g]) if t[k] < t[g] else (t[g], t[k], root[g], root[k]) for g in good.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([int(x[c]) for x in found], pa.int64()) for c in range(4)], names=["a", "b", "a_root", "b_root"])

    def run(batches):
        block, rows = None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("key", "part", "other", "t", "root", "words", "bins", "own")]
            for key, part, other, *row in zip(*columns):
                if (key, part, other) != block:
                    if len(rows) > 1:
                        yield close(rows)
                    block, rows = (key, part, other), []
                rows.append(row)
        if len(rows) > 1:
            yield close(rows)

    return run


def _apart(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Distinct pairs ``a, b, a_root, b_root`` that share a key of ``rows`` (``key, t, root, words``)
    and could be similar enough."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("t", F.lit("part")), F.col("parts")).cast("int")
    placed = rows.join(sizes, "key").join(texts.select("t", "bins"), "t").withColumn("mine", mine)
    placed = placed.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # own: 0 and 1 tell the two parts of a block apart, 2 is a block of one part
    own = F.when(F.col("mine") == F.col("facing"), 2).when(F.col("mine") < F.col("facing"), 0).otherwise(1)
    placed = placed.select("key", F.least("mine", "facing").alias("part"), F.greatest("mine", "facing").alias("other"), "t", "root", "words", "bins", own.alias("own"))
    ordered = placed.repartition("key", "part", "other").sortWithinPartitions("key", "part", "other")
    return ordered.mapInArrow(lean(_meetings(least)), "a long, b long, a_root long, b_root long").distinct()


def links(docs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """``t, root`` for the texts that were found similar to others: texts with one root are
    connected by verified links. ``texts`` has a row ``t, h, words, bins, keys`` for each text."""
    keyed = texts.select("t", F.explode("keys").alias("key"))
    words = texts.select("t", "words")

    def led(rows, turn):
        """Rows of buckets in which two classes meet, with the text that leads: ``a, aw, a_root``."""
        lead = F.min(F.struct(F.xxhash64("t", F.lit(turn)), "t", "words", "root"))
        leaders = rows.groupBy("key").agg(lead.alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        return rows.join(leaders.select("key", F.col("lead.t").alias("a"), F.col("lead.words").alias("aw"), F.col("lead.root").alias("a_root")), "key")

    # all keys of all texts are shuffled as two numbers; the least text leads first
    leaders = keyed.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("high")).where("a <> high").select("key", "a")
    met = table(keyed.join(leaders, "key"), "met")
    open_ = met.join(words, "t").join(words.toDF("a", "aw"), "a").select("key", "t", "words", F.col("t").alias("root"), "a", "aw", F.col("a").alias("a_root"))
    open_ = table(open_, "buckets")
    near = F.least("words", "aw") >= F.lit(least) * F.greatest("words", "aw") - 1e-9
    roots = None
    for turn in range(LEADER_ROUNDS + 1):
        if turn < LEADER_ROUNDS:
            votes = open_.where((F.col("root") != F.col("a_root")) & near).groupBy("t", "root", "a", "a_root").agg(F.count("*").alias("n"))
            best = votes.groupBy("t").agg(F.max(F.struct("n", "a", "a_root", "root")).alias("m"))
            pairs = best.select("m.a", F.col("t").alias("b"), "m.a_root", F.col("m.root").alias("b_root"))
        else:
            pairs = _apart(open_.select("key", "t", "root", "words"), texts, least)
        joined = components(_verified(pairs, texts, docs, least))
        if roots is None:
            roots = joined
        else:
            over = joined.select(F.col("t").alias("old"), F.col("root").alias("new"))
            further = roots.join(over, F.col("root") == F.col("old"), "left").select("t", F.coalesce("new", "root").alias("root"))
            roots = cut(further.unionByName(joined.join(roots, "t", "left_anti")))
        if turn < LEADER_ROUNDS:
            moved = joined.select(F.col("t").alias("old"), F.col("root").alias("new"))
            now = open_.select("key", "t", "words", "root").join(moved, F.col("root") == F.col("old"), "left").select("key", "t", "words", F.coalesce("new", "root").alias("root"))
            open_ = table(led(now, turn + 1), "buckets")
    return roots


def components(edges: DataFrame) -> DataFrame:
    """``t, root``: least number of each connected component of ``a_root, b_root``, by taking the
    least of the neighbours and jumping along roots. Loops and repeated edges change nothing."""
    edges = edges.toDF("t", "other")
    both = cut(edges.union(edges.select("other", "t")).distinct())
    labels = cut(both.groupBy("t").agg(F.least(F.col("t"), F.min("other")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("t").alias("other"), "root"), "other").groupBy("t").agg(F.min("root").alias("near"))
        lower = labels.join(near, "t").select("t", F.least("root", "near").alias("new"), "root")
        jump = labels.select(F.col("t").alias("new"), F.col("root").alias("far"))
        nxt = cut(lower.join(jump, "new", "left").select("t", F.least("new", F.coalesce("far", "new")).alias("new"), "root"))
        if nxt.where("new <> root").isEmpty():
            return labels
        labels = nxt.select("t", F.col("new").alias("root"))


def _placed(docs: DataFrame, least: float) -> DataFrame:
    """``doc_id, h, root`` of every row, and ``keep``: the least id of the class, null last, with its text."""
    sketched = table(_sketched(docs), "sketches")
    first = [F.first(c).alias(c) for c in ("words", "bins", "keys")]
    least_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("keep")
    texts = table(sketched.groupBy("h").agg(*first, least_id).withColumn("t", F.monotonically_increasing_id()), "distinct-texts")
    roots = links(docs, texts, least)
    known = texts.select("h", "keep", "t").join(roots, "t", "left").select("h", "keep", F.coalesce("root", "t").alias("root"))
    kept = known.groupBy("root").agg(F.min("keep").alias("keep"))
    by_text = table(known.select("h", "root").join(kept, "root"), "classes")
    # a text that a third of all rows have: its side is one row, the rows' side is split by adaptive skew joins
    return sketched.select("doc_id", "h").join(by_text, "h")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, h, class_id``: a row per row of ``docs``.

    ``class_id`` is the least ``doc_id`` of the class, null only if all its ids are null;
    ``h`` the MD5 of the text. Null texts count as empty, and all texts without words are near
    copies of each other. Repeated rows are in one class; ids tie only among rows of one id,
    which changes no class; an empty table gives an empty table; other columns are ignored.
    """
    return _placed(docs, least).select("doc_id", "h", F.col("keep.doc_id").alias("class_id"))


def deduplicate(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows of ``docs``, one of each class: that of least ``doc_id``, null last, of several rows
    with it that of least text hash, of rows alike in both any one. Classes whose ids are all
    null keep a row each. Empty tables stay empty; other columns pass through."""
    placed = table(_placed(docs, least), "placed")
    gone = placed.where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("h") == F.col("keep.h")))).select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h")).distinct()
    twice = not placed.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST_KEYS) else gone
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.unhex(F.md5(_raw())).alias("hash"))
    kept = held.join(gone, F.col("key").eqNullSafe(F.col("g_id")) & (F.col("hash") == F.col("g_h")), "left_anti")
    if twice:
        kept = kept.dropDuplicates(["key", "hash"])
    return kept.select("row.*")
