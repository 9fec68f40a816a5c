"""Mixing sources to target weights.

Tokens are summed per source, each source gets a repetition rate, and every document is
emitted ``floor(rate)`` times plus one copy drawn from a hash of its id with probability
equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm._common import WORD, cut, small_enough

#: Sources up to this many are broadcast (a few MB); beyond it the join is salted and shuffled.
BROADCAST_SOURCES = 50_000
SALTS = 16


def text_size(text):
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``g_rank`` from 0 by code point, null last, without one task that sees all sources."""
    spark = sources.sparkSession
    parts = max(1, -(-sources.count() // 100_000))
    order = [F.col("g_source").isNull(), F.col("g_source")]
    ranged = cut(sources.repartitionByRange(parts, *order).withColumn("g_pid", F.spark_partition_id()))
    offsets, seen = [], 0
    for pid, n in sorted((r.g_pid, r["count"]) for r in ranged.groupBy("g_pid").count().collect()):
        offsets.append((pid, seen))
        seen += n
    starts = spark.createDataFrame(offsets, "g_pid int, g_start long")
    place = F.row_number().over(W.partitionBy("g_pid").orderBy(*order))
    return (
        ranged.withColumn("g_place", place)
        .join(F.broadcast(starts), "g_pid")  # a row for each 100,000 sources
        .withColumn("g_rank", F.col("g_start") + F.col("g_place") - 1)
        .drop("g_pid", "g_start", "g_place")
    )


def source_rates(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target of each source.

    ``sizes`` has ``g_source`` and ``g_size``. Sources in code-point order (null last) take
    ``weights`` in turn and share ``share`` times all words; no target exceeds ``cap`` times
    its source's words, what is cut off goes to the others by weight. Returns ``g_source``,
    ``g_source_size``, ``g_target``, ``g_rate`` (0 for a source without words). An empty
    input gives an empty table.
    """
    sources = sizes.groupBy("g_source").agg(F.sum("g_size").alias("g_source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(_ranked(cut(sources)).withColumn("g_w", F.get(turn, (F.col("g_rank") % len(weights)).cast("int"))))
    room = F.col("g_source_size") * F.lit(cap)
    total = ranked.agg(F.sum("g_source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # a source is full once its room lies below its share; the level only rises
        is_full = room < F.lit(level) * F.col("g_w")
        used, free, n = ranked.agg(
            F.coalesce(F.sum(F.when(is_full, room)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("g_w"))), F.lit(0.0)),
            F.count(F.when(is_full, 1)),
        ).first()
        if n == full:
            break
        full = n
        level = (share * total - used) / free if free else float("inf")
    target = F.least(room, F.lit(level) * F.col("g_w"))
    rate = F.when(F.col("g_source_size") > 0, F.col("g_target") / F.col("g_source_size")).otherwise(0.0)
    return ranked.select("g_source", "g_source_size", target.alias("g_target")).withColumn("g_rate", rate)


def with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Joins ``g_source`` of ``docs`` with the rates; null matches null. A hot source is salted."""
    if small_enough(rates, BROADCAST_SOURCES):
        r = F.broadcast(rates.withColumnRenamed("g_source", "g_key"))
        return docs.join(r, docs["g_source"].eqNullSafe(r["g_key"]), "left").drop("g_key")
    salted = docs.withColumn("g_salt", F.pmod(F.xxhash64(*[c for c in docs.columns if c.startswith("g_")]), F.lit(SALTS)))
    r = rates.withColumnRenamed("g_source", "g_key").withColumn("g_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = salted["g_source"].eqNullSafe(r["g_key"]) & (salted["g_salt"] == r["g_salt2"])
    return salted.join(r, on, "left").drop("g_key", "g_salt", "g_salt2")


def draw(doc_id, seed: str):
    """Number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def copies(rate, doc_id, seed: str):
    """``floor(rate)`` plus the drawn copy."""
    whole = F.floor(rate)
    return (whole + (draw(doc_id, seed) < rate - whole).cast("long")).cast("long")


def mix_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: how often the mix takes it.

    Returns ``doc_id, source, size, source_size, target, rate, copies``. Null texts have size
    0; null sources form a source of their own; rows with one id draw alike; an empty table
    gives an empty table; other columns of ``docs`` are ignored.
    """
    sizes = cut(docs.select(F.col("doc_id").alias("g_id"), F.col("source").alias("g_source"), text_size(F.col("text")).alias("g_size")))
    rates = source_rates(sizes, weights, share, cap)
    return with_rates(sizes, rates).select(
        F.col("g_id").alias("doc_id"),
        F.col("g_source").alias("source"),
        F.col("g_size").alias("size"),
        F.col("g_source_size").alias("source_size"),
        F.col("g_target").alias("target"),
        F.col("g_rate").alias("rate"),
        copies(F.col("g_rate"), F.col("g_id"), seed).alias("copies"),
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken.

    Defined for odd rows as in ``mix_plan``.
    """
    sizes = docs.select(F.col("source").alias("g_source"), text_size(F.col("text")).alias("g_size"))
    rates = source_rates(sizes, weights, share, cap).select("g_source", "g_rate")
    joined = with_rates(docs.withColumn("g_source", F.col("source")).withColumn("g_id", F.col("doc_id")), rates)
    n = copies(F.coalesce("g_rate", F.lit(0.0)), F.col("g_id"), seed)
    taken = joined.withColumn("g_n", n.cast("int")).where("g_n > 0")
    return taken.withColumn("g_copy", F.explode(F.array_repeat(F.lit(1), F.col("g_n")))).select(*docs.columns)
