"""Benchmark decontamination with SimHash windows, in DataFrame operations alone.

For a benchmark item of L words, windows of L words of a document are compared with the item.
They start where a shared shingle stands, as the best one does, and where at least ``SHARE`` of
the window's shingles are shared; others have similarities below a third. Windows and items get
128-bit SimHash fingerprints of their weighted shingles. Fingerprints are cut into ``BLOCKS``
blocks: of two that differ in at most ``RADIUS`` bits some block differs in at most
``RADIUS // BLOCKS``, so a join of the windows' blocks with all those neighbours of the items'
blocks finds all of them. At the threshold of 0.8 the expected distance is 19 bits with a
deviation of 4. Found pairs are verified by exact weighted-shingle similarity, the sum of the
lesser counts over the sum of the greater.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import GAP, cut, small_enough, table

SHINGLE, LEAST, SHARE = 5, 0.8, 0.5
RADIUS, BLOCKS = 32, 11
#: Rows of item shingles, of blocks of items, or of keys of documents, that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case words without the marks around them; words of marks alone are dropped."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<![\p{L}\p{N}])[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?![\p{L}\p{N}])", " ")
    return F.filter(F.split(bare, GAP), lambda w: w != "")


def shingles(ws: Column, k: int = SHINGLE) -> Column:
    """Hashes of the runs of ``k`` words; none if there are fewer."""
    n = F.size(ws)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds ``f0, f1``, the 128-bit SimHash of the shingles ``h``: bit k is set if it is in most of them."""
    bits = "aggregate(sequence(0, 63), 0L, (f, k) -> f | shiftleft(cast(2 * aggregate({0}, 0, (n, s) -> n + cast(shiftrightunsigned(s, k) & 1L as int)) > size(h) as bigint), k))"
    return rows.withColumns({"f0": F.expr(bits.format("h")), "f1": F.expr(bits.format("transform(h, s -> xxhash64(s, 1))"))})


def _blocks() -> Column:
    """Array of (number, bits) for the ``BLOCKS`` blocks of the 128 bits."""
    edges = [round(k * 128 / BLOCKS) for k in range(BLOCKS + 1)]
    parts = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        value = F.lit(0).cast("long")
        for f, base in (("f0", 0), ("f1", 64)):
            a, b = max(lo, base), min(hi, base + 64)
            if a < b:
                value = value * F.lit(1 << (b - a)) + F.shiftrightunsigned(F.col(f), a - base).bitwiseAND(F.lit((1 << (b - a)) - 1))
        parts.append(F.struct(F.lit(k).alias("block"), value.alias("bits")))
    return F.explode(F.array(*parts))


def _near_masks() -> Column:
    """All ways in which a block may differ in at most ``RADIUS // BLOCKS`` bits."""
    width = -(-128 // BLOCKS)
    masks = [sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), n)]
    return F.explode(F.lit(masks).cast("array<bigint>"))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """``win, n_words, item, distance`` of windows and items of one length whose fingerprints
    (``f0, f1``) differ in at most ``RADIUS`` bits."""
    theirs = items.select("item", "n_words", F.col("f0").alias("g0"), F.col("f1").alias("g1"), _blocks().alias("b"))
    index = theirs.select("item", "n_words", "g0", "g1", "b.*", _near_masks().alias("mask")).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask"))).drop("mask")
    probes = windows.select("win", "n_words", "f0", "f1", _blocks().alias("b")).select("win", "n_words", "f0", "f1", "b.*")
    distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    near = probes.join(_hint(index), ["n_words", "block", "bits"]).withColumn("distance", distance).where(F.col("distance") <= RADIUS)
    return near.select("win", "n_words", "item", "distance").distinct()


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, start, similarity, distance``: the best window of each leaked pair.

    ``start`` counts words from 0; of windows alike the first that starts at a shared shingle counts. A window has as many words
    as the item, or all the document's if it has fewer. Items of fewer than ``SHINGLE`` words
    are one shingle of that length. Null and blank texts match nothing. Rows with equal id and
    text count once, of rows with one id and different texts the best match is returned. Empty
    tables give an empty table; other columns are ignored.
    """
    read = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w")).where("n_words > 0")
    short = [r.n_words for r in read.where(F.col("n_words") < SHINGLE).select("n_words").distinct().orderBy("n_words").collect()]  # at most SHINGLE - 1 rows
    long_ = _leaks_of_long(docs, read.where(F.col("n_words") >= SHINGLE), least)
    found = [long_, *[_leaks_of_short(docs, read.where(F.col("n_words") == k), k) for k in short]]
    return reduce(DataFrame.unionByName, found)


def _leaks_of_short(docs: DataFrame, read: DataFrame, k: int) -> DataFrame:
    """Occurrences of items that are a single shingle of ``k`` words."""
    items = read.select("item_id", F.get(shingles(F.col("w"), k), 0).alias("s")).distinct()
    at = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.posexplode_outer(shingles(F.col("w"), k)).alias("pos", "s"))
    first = at.join(_hint(items), "s").groupBy("doc_id", "item_id").agg(F.min("pos").alias("start"))
    return first.select("doc_id", "item_id", "start", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"))


def _leaks_of_long(docs: DataFrame, read: DataFrame, least: float) -> DataFrame:
    items = read.select("item_id", "n_words", shingles(F.col("w")).alias("h")).dropDuplicates(["item_id", "h"])
    items = cut(with_fingerprints(items.withColumn("n", F.size("h")).withColumn("item", F.xxhash64("item_id", "h"))))
    anchors = items.select("item", "n_words", "n", F.explode(F.array_distinct("h")).alias("s"))

    hashed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("t"), words(F.col("text")).alias("w")).select("doc_id", "t", F.size("w").alias("len"), shingles(F.col("w")).alias("h"))
    # outer, as an inferred filter on the array would be pushed down with the whole expression inside
    at = hashed.select("doc_id", "t", "len", F.posexplode_outer("h").alias("pos", "s"))
    hits = table(at.join(_hint(anchors), "s").select("doc_id", "t", "len", "pos", "item", "n_words", "n").distinct(), "shared-shingles")

    # a best window starts at a shared shingle, unless the document's end pushes it back
    span = F.col("n")
    follow = W.partitionBy("doc_id", "t", "item").orderBy("pos")
    after = hits.withColumn("rank", F.row_number().over(follow)).withColumn("all", F.count("*").over(W.partitionBy("doc_id", "t", "item")))
    enough = F.ceil(F.lit(SHARE) * span - 1e-9)
    able = after.where(F.col("all") >= enough)
    # the k-th shared shingle from here must still lie within the window
    ahead = able.select(F.col("doc_id").alias("a_id"), F.col("t").alias("a_t"), F.col("item").alias("a_item"), (F.col("rank") - enough + 1).alias("a_rank"), F.col("pos").alias("reach"))
    starts = able.join(ahead, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("t") == F.col("a_t")) & (F.col("item") == F.col("a_item")) & (F.col("rank") == F.col("a_rank"))).where(F.col("reach") - F.col("pos") < span)
    begin = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("len") - F.col("n_words")))
    windows = table(starts.select("doc_id", "t", "n_words", "n", begin.alias("start")).distinct(), "windows")

    few = _hint(windows.select("doc_id", "t").distinct())
    again = hashed.join(few.select(F.col("doc_id").alias("k_id"), F.col("t").alias("k_t")), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("t") == F.col("k_t")), "left_semi")
    again = again.select("doc_id", "t", "h").dropDuplicates(["doc_id", "t"])
    keyed = windows.withColumnsRenamed({"doc_id": "w_id", "t": "w_t"})
    held = keyed.join(again, F.col("w_id").eqNullSafe(F.col("doc_id")) & (F.col("w_t") == F.col("t"))).select(
        "doc_id", "t", "n_words", "start", F.slice("h", F.col("start") + 1, F.col("n")).alias("h")
    )
    held = table(held.withColumn("win", F.xxhash64("h")), "window-shingles")

    # equal windows are looked at once
    contents = table(with_fingerprints(held.groupBy("win", "n_words").agg(F.first("h").alias("h"))), "window-contents")
    near = within_radius(contents, items)

    pairs = near.join(contents.select("win", "n_words", "h"), ["win", "n_words"]).join(items.select("item", "item_id", F.col("h").alias("g")), "item")
    counted = pairs.select(
        "win", "n_words", "item", "item_id", "distance", F.explode(F.concat(F.transform("h", lambda s: F.struct(s.alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("g", lambda s: F.struct(s.alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).alias("x")
    ).select("win", "n_words", "item", "item_id", "distance", "x.*")
    weights = counted.groupBy("win", "n_words", "item", "item_id", "distance", "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sure = (
        weights.groupBy("win", "n_words", "item", "item_id", "distance")
        .agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity"))
        .where(F.col("similarity") >= F.lit(least) - 1e-12)
    )
    found = held.drop("h").join(sure, ["win", "n_words"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.s")).alias("start"), F.col("m.similarity").alias("similarity"), (-F.col("m.d")).cast("int").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` has no leak; rows with null ids go if null has one."""
    bad = table(leaks(docs, benchmark, least).select(F.col("doc_id").alias("g_bad")).distinct(), "leaked")
    return docs.join(_hint(bad), F.col("doc_id").eqNullSafe(F.col("g_bad")), "left_anti")
