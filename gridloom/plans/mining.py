"""Substructure mining: which runs and blocks a matrix has, as window computations.

Coordinates are distinct. Every statistic is a table ``type, inst, nnz, pat``: with ``inst`` a
stride for linear types and the free dimension for blocks, how many non-zeros how many
patterns would hold. Nothing here brings coordinates to the driver; statistics, a few hundred
rows at most, are brought there to plan.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.xform import transformed
from gridloom.model import Matrix, spread
from gridloom.options import LINEAR, TYPE_ORDER, TYPES, Options, alignment, parse_types


def coordinates(a: Matrix) -> DataFrame:
    """Distinct ``i, j``."""
    coords = a.df.select("i", "j")
    return coords if a.distinct else spread(coords, a.bound, "i", "j").distinct()


def ordered(coords: DataFrame, kind: str, n: int, m: int, most: int | None = None) -> DataFrame:
    """Transformed ``a, b``, with ``part`` kept if there is one, groups spread over partitions for
    the windows to come. ``most`` bounds the rows; they are counted without it."""
    keep = [c for c in ("part",) if c in coords.columns]
    t = transformed(coords, kind, n, m).select(*keep, "a", "b")
    return spread(t, coords.count() if most is None else most, *_keys(t))


def _keys(t: DataFrame) -> list[str]:
    return [c for c in ("part", "a") if c in t.columns]


def delta_encode(t: DataFrame) -> DataFrame:
    """``a, b, k``: the first ``b`` of each ``a``, then differences."""
    w = W.partitionBy(*_keys(t)).orderBy("b")
    return t.withColumn("k", F.col("b") - F.coalesce(F.lag("b").over(w), F.lit(0)))


def max_delta(t: DataFrame) -> DataFrame:
    """``max_delta`` over all gaps, first values left out."""
    w = W.partitionBy(*_keys(t)).orderBy("b")
    return t.select((F.col("b") - F.lag("b").over(w)).alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("max_delta"))


def runs(t: DataFrame) -> DataFrame:
    """``a, q, k, f``: run number q of equal differences k, f of them."""
    keys = _keys(t)
    w = W.partitionBy(*keys).orderBy("b")
    changed = delta_encode(t).withColumn("pk", F.lag("k").over(w)).withColumn("new", F.when(F.col("k") == F.col("pk"), 0).otherwise(1))
    return changed.withColumn("q", F.sum("new").over(w)).groupBy(*keys, "q").agg(F.min("k").alias("k"), F.count("*").alias("f"))


def accepted_runs(t: DataFrame, shortest: int) -> DataFrame:
    """Runs with ``acc`` (whether encoded) and ``rn`` (elements with the one before, if it is free).

    A run is accepted with ``shortest`` elements, or one fewer if the run before was not. Only
    runs of exactly one fewer depend on the run before, so their bit is the last certain one
    flipped once a run: run number and parity are packed in one number, and a running maximum
    carries it.
    """
    keys = _keys(t)
    w = W.partitionBy(*keys).orderBy("q")
    f, q = F.col("f"), F.col("q")
    open_ = (q > 1) & (f > 1) & (f == shortest - 1)
    sure = F.when((f > 1) & (f >= shortest), 1).otherwise(0)
    packed = F.max(F.when(~open_, q * 2 + (sure + q) % 2)).over(w)
    bits = runs(t).withColumn("z", packed).withColumn("acc", (F.col("z") % 2 + q) % 2)
    lead = F.when((q > 1) & (F.lag("acc").over(w) == 0), 1).otherwise(0)
    return bits.withColumn("rn", f + lead).drop("z")


def linear_stats(t: DataFrame, options: Options) -> DataFrame:
    """``inst, nnz, pat`` by stride; runs are cut at the longest unit, short remainders dropped."""
    left = F.col("rn") % options.max_unit
    whole = (F.col("rn") - left) / options.max_unit
    fits = left >= options.min_unit
    by = ["part"] if "part" in t.columns else []
    return accepted_runs(t, options.min_unit).where("acc = 1").groupBy(*by, F.col("k").alias("inst")).agg(
        F.sum(F.col("rn") - F.when(fits, 0).otherwise(left)).cast("long").alias("nnz"), F.sum(whole + F.when(fits, 1).otherwise(0)).cast("long").alias("pat")
    )


def islands(t: DataFrame, align: int) -> DataFrame:
    """Runs of consecutive positions: ``isl, begin`` (first aligned position) and ``od`` whole columns."""
    keys = _keys(t)
    w = W.partitionBy(*keys).orderBy("b")
    isl = t.withColumn("isl", F.col("b") - F.row_number().over(w)).groupBy(*keys, "isl").agg(F.count("*").alias("len"), F.min("b").alias("lo"))
    skip = (F.lit(align) - (F.col("lo") - 1) % align) % align
    return isl.withColumn("skip", skip).where("len > skip").select(*keys, "isl", (F.col("lo") + F.col("skip")).alias("begin"), F.floor((F.col("len") - F.col("skip")) / F.lit(align)).cast("long").alias("od"))


def block_stats(t: DataFrame, align: int) -> DataFrame:
    by = ["part"] if "part" in t.columns else []
    return islands(t, align).where("od >= 2").groupBy(*by, F.col("od").alias("inst")).agg(F.sum(F.col("od") * align).cast("long").alias("nnz"), F.count("*").alias("pat"))


def type_stats(coords: DataFrame, kind: str, n: int, m: int, options: Options, most: int | None = None) -> DataFrame:
    t = ordered(coords, kind, n, m, most)
    stats = linear_stats(t, options) if kind in LINEAR else block_stats(t, alignment(kind))
    return stats.select(*[c for c in ("part",) if c in stats.columns], F.lit(kind).alias("type"), "inst", "nnz", "pat")


def wanted_types(options: Options) -> list[str]:
    """Types to look for; one-dimensional blocks only on request."""
    names = parse_types(options.types)
    return [t for t in TYPES if t in names and (options.one_dim_blocks or t not in ("br1", "bc1"))]


def all_stats(coords: DataFrame, n: int, m: int, options: Options, types=None, most: int | None = None) -> DataFrame:
    out, most = None, coords.count() if most is None else most
    for kind in wanted_types(options) if types is None else types:
        one = type_stats(coords, kind, n, m, options, most)
        out = one if out is None else out.unionByName(one)
    return out


def merge(*stats: DataFrame) -> DataFrame:
    """Statistics added up by type and instance."""
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out.groupBy("type", "inst").agg(F.sum("nnz").alias("nnz"), F.sum("pat").alias("pat"))


def rollup(stats: DataFrame) -> DataFrame:
    """Sums by instance, by type and overall (``level`` 0, 1, 2).

    As in SQL there is an overall row even without statistics: Spark makes none of an empty table,
    so a row that counts nowhere goes along.
    """
    nothing = stats.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in stats.dtypes], F.lit(0).alias("real"))
    rows = stats.withColumn("real", F.lit(1)).unionByName(nothing)
    total = rows.rollup("type", "inst").agg(F.sum("nnz").alias("nnz"), F.sum("pat").alias("pat"), F.sum("real").alias("real"), F.grouping_id().alias("g"))
    return total.where("real > 0 OR g = 3").select("type", "inst", "nnz", "pat", F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2).alias("level"))


def scaled(stats: DataFrame, factor: float) -> DataFrame:
    return stats.select("type", "inst", *[F.floor(F.col(c) * F.lit(float(factor))).cast("long").alias(c) for c in ("nnz", "pat")])


def covered(stats: DataFrame, total: int, least: float) -> DataFrame:
    """Instances that hold at least the share ``least`` of all non-zeros."""
    return stats.where(F.col("nnz") >= F.lit(float(least)) * F.lit(total))


def without_zeros(stats: DataFrame) -> DataFrame:
    return stats.where("nnz > 0 AND pat > 0")


@dataclasses.dataclass
class Stat:
    nnz: int
    pat: int


def split_blocks(stats: dict[tuple[str, int], Stat], total: int, options: Options) -> dict[tuple[str, int], Stat]:
    """Blocks too large for a unit are split, then wide ones of low coverage go into the next
    narrower width that is covered, the remainder (unless one column) staying as a block."""
    out = {k: Stat(s.nnz, s.pat) for k, s in stats.items()}

    def give(kind, dim, align, pats):
        s = out.setdefault((kind, dim), Stat(0, 0))
        s.nnz += dim * align * pats
        s.pat += pats

    for kind in {k for k, _ in stats if alignment(k)}:
        align = alignment(kind)
        most = options.max_unit // align
        for dim in sorted((d for k, d in list(out) if k == kind and d > most), reverse=True):
            s = out.pop((kind, dim))
            give(kind, most, align, dim // most * s.pat)
            if dim % most >= 2:
                give(kind, dim % most, align, s.pat)
        dims = sorted(d for k, d in out if k == kind)
        good = [d for d in dims if out[kind, d].nnz >= options.min_coverage * total]
        for dim in reversed(dims):
            into = max((d for d in good if d < dim), default=0)
            if dim in good or not into:
                continue
            s = out.pop((kind, dim))
            give(kind, into, align, dim // into * s.pat)
            if dim % into >= 2:
                give(kind, dim % into, align, s.pat)
    return out


def score(stats: DataFrame, heuristic: str = "ratio") -> DataFrame:
    """``type, score``: non-zeros held less patterns; with ``cost`` less switches between patterns too."""
    by_type = stats.groupBy("type").agg(F.sum("nnz").alias("nnz"), F.sum("pat").alias("pat"))
    gain = F.col("nnz") - F.col("pat")
    return by_type.select("type", (gain if heuristic == "ratio" else F.greatest(F.lit(0), gain - F.col("pat"))).cast("long").alias("score"))


def choose(scores: DataFrame) -> DataFrame:
    """The type of the highest positive score, of equal ones the earlier type; no row if there is none."""
    order = F.create_map(*[F.lit(x) for p in TYPE_ORDER.items() for x in p])
    return scores.where("score > 0").withColumn("o", F.element_at(order, F.col("type"))).orderBy(F.desc("score"), "o").limit(1).select("type", "score")


def delta_bytes(x) -> F.Column:
    """Bytes that hold a gap: 1, 2, 4 or 8."""
    return F.when(x < 256, 1).when(x < 65536, 2).when(x < 2**32, 4).otherwise(8)


def delta_unit_stats(coords: DataFrame, options: Options, index_bytes: int = 4, most: int | None = None) -> DataFrame:
    """``units, saved``: delta units of the rows, and the column numbers that narrow gaps save."""
    w = W.partitionBy("i").orderBy("j")
    coords = spread(coords, coords.count() if most is None else most, "i")
    gaps = coords.withColumn("k", F.col("j") - F.coalesce(F.lag("j").over(w), F.lit(0)))
    rows = gaps.groupBy("i").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    saved = F.greatest(F.lit(0), F.lit(index_bytes) - delta_bytes(F.col("k"))) * F.col("n") / index_bytes
    return rows.agg(F.sum(F.ceil(F.col("n") / options.max_unit)).cast("long").alias("units"), F.sum(F.floor(saved)).cast("long").alias("saved"))


def row_windows(a: Matrix, window: int) -> DataFrame:
    """``w, start, end, nnz``: consecutive rows of about ``window`` non-zeros.

    A row belongs to the window in which its first non-zero falls, so bounds come from the
    running count and no row waits for the one before it.
    """
    from gridloom.sources.csr import row_pointers

    ptr = row_pointers(a).withColumn("w", F.floor((F.col("stop") - F.col("n")) / max(1, window)))
    return ptr.groupBy("w").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.sum("n").alias("nnz"))


def windows_by_rows(nrows: int, size: int) -> list[tuple[int, int]]:
    return [(s, min(s + size, nrows)) for s in range(0, nrows, size)]


def pick_windows(n: int, samples: int) -> list[int]:
    """Numbers of the windows to sample: all if there are few, else evenly spaced."""
    if samples >= n:
        return list(range(n))
    if samples > n / 2:
        half = list(range(samples // 2))
        rest = samples - len(half)
        return half + [len(half) + k * (n - len(half)) // rest for k in range(rest)]
    skip = n // (samples + 1)
    return [(k + 1) * skip for k in range(samples)]


def sampling_plan(nnz: int, options: Options) -> tuple[int, int]:
    """Samples and non-zeros of a window, of one part."""
    samples = math.ceil(options.samples / options.parts)
    window = options.window if options.sampling == "window" else int(options.portion * nnz / samples)
    return samples, max(1, window)


def sampled_stats(a: Matrix, options: Options, types=None) -> DataFrame:
    """Statistics of sampled windows of rows, each mined alone, scaled to the matrix."""
    coords = coordinates(a)
    samples, window = sampling_plan(a.nnz, options)
    if options.sampling == "none" or a.nrows <= samples:
        return all_stats(coords, a.nrows, a.ncols, options, types, a.most)
    numbered = row_windows(a, window).withColumn("k", F.row_number().over(W.orderBy("w")) - 1)
    n = numbered.count()
    chosen = numbered.join(F.broadcast(a.df.sparkSession.createDataFrame([(k,) for k in sorted(set(pick_windows(n, samples)))], "k int")), "k")
    part = coords.join(F.broadcast(chosen.select(F.col("k").alias("part"), "start", "end")), (F.col("i") >= F.col("start")) & (F.col("i") < F.col("end")))
    part = part.select("part", (F.col("i") - F.col("start")).alias("i"), "j")
    taken = part.count()
    stats = all_stats(part, a.nrows, a.ncols, options, types, taken)
    return scaled(merge(stats.drop("part")), coords.count() / taken if taken else 0)
