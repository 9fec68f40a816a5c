"""Dense vectors: DataFrames ``i long, v double`` with a row for each of ``0 .. size-1``.

Ranges are half open. Operations return new vectors; a ``_part`` form changes the range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError, BoundsError, DimensionError, fail

TOLERANCE = 1e-6


def _within(start: int, end: int):
    return (F.col("i") >= start) & (F.col("i") < end)


def create(spark: SparkSession, size: int, value: float = 0.0) -> DataFrame:
    if size < 0:
        raise ArgumentError("negative size")
    return spark.range(size).select(F.col("id").alias("i"), F.lit(float(value)).alias("v"))


def from_buffer(spark: SparkSession, values, keep: bool = False) -> DataFrame:
    """Vector of a list or array; ``keep`` persists it."""
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i long, v double")
    return df.persist() if keep else df


def _uniform(seed: int):
    return F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def random(spark: SparkSession, size: int, seed: int = 0, low: float = -0.1, high: float = 0.1) -> DataFrame:
    """Uniform in [low, high), a function of index and seed alone."""
    return init_random(create(spark, size), high, low, seed)


def init(v: DataFrame, value: float) -> DataFrame:
    return v.select("i", F.lit(float(value)).alias("v"))


def init_part(v: DataFrame, value: float, start: int, end: int) -> DataFrame:
    return v.select("i", F.when(_within(start, end), F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def init_random(v: DataFrame, high: float, low: float, seed: int = 0) -> DataFrame:
    return v.select("i", (F.lit(float(low)) + _uniform(seed) * float(high - low)).alias("v"))


def init_random_part(v: DataFrame, high: float, low: float, start: int, end: int, seed: int = 0) -> DataFrame:
    return v.select("i", F.when(_within(start, end), F.lit(float(low)) + _uniform(seed) * float(high - low)).otherwise(F.col("v")).alias("v"))


def set_entry(v: DataFrame, index: int, value: float, size: int, base: int = 0) -> DataFrame:
    if not 0 <= index - base < size:
        return fail(BoundsError(f"{index} of {size}"))
    return v.select("i", F.when(F.col("i") == index - base, F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def scale(v: DataFrame, num: float) -> DataFrame:
    return v.select("i", (F.col("v") * float(num)).alias("v"))


def scale_part(v: DataFrame, num: float, start: int, end: int) -> DataFrame:
    return v.select("i", F.when(_within(start, end), F.col("v") * float(num)).otherwise(F.col("v")).alias("v"))


def _pair(a: DataFrame, b: DataFrame, sizes=None) -> DataFrame:
    if sizes is not None and len(set(sizes)) > 1:
        fail(DimensionError(f"sizes {sizes}"))
    return a.select("i", F.col("v").alias("a")).join(b.select("i", F.col("v").alias("b")), "i")


def scale_add(a: DataFrame, b: DataFrame, num: float, sizes=None) -> DataFrame:
    """``a + num*b``."""
    return _pair(a, b, sizes).select("i", (F.col("a") + float(num) * F.col("b")).alias("v"))


def _part(a, b, old, start, end, expr) -> DataFrame:
    both = _pair(a, b).join(old.select("i", F.col("v").alias("old")), "i")
    return both.select("i", F.when(_within(start, end), expr).otherwise(F.col("old")).alias("v"))


def scale_add_part(a, b, old, num: float, start: int, end: int) -> DataFrame:
    """``a + num*b`` within the range, ``old`` outside it."""
    return _part(a, b, old, start, end, F.col("a") + float(num) * F.col("b"))


def add(a, b, sizes=None) -> DataFrame:
    return scale_add(a, b, 1.0, sizes)


def add_part(a, b, old, start: int, end: int, size: int | None = None) -> DataFrame:
    if start < 0 or end < start or (size is not None and end > size):
        return fail(BoundsError(f"[{start}, {end}) of {size}"))
    return _part(a, b, old, start, end, F.col("a") + F.col("b"))


def sub(a, b, sizes=None) -> DataFrame:
    return _pair(a, b, sizes).select("i", (F.col("a") - F.col("b")).alias("v"))


def sub_part(a, b, old, start: int, end: int) -> DataFrame:
    return _part(a, b, old, start, end, F.col("a") - F.col("b"))


def dot(a, b, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row ``dot``, over the range if one is given."""
    both = _pair(a, b)
    both = both if start is None else both.where(_within(start, end))
    return both.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("dot"))


def reorder(v: DataFrame, perm: DataFrame) -> DataFrame:
    """``out[perm[i]] = v[i]``; ``perm`` has ``old_i, new_i``."""
    return v.join(perm, v["i"] == perm["old_i"]).select(F.col("new_i").alias("i"), "v")


def inverse_reorder(v: DataFrame, perm: DataFrame) -> DataFrame:
    """``out[i] = v[perm[i]]``."""
    return v.join(perm, v["i"] == perm["new_i"]).select(F.col("old_i").alias("i"), "v")


def copy(v: DataFrame) -> DataFrame:
    return v.select("i", "v")


def compare(a, b, size_a: int, size_b: int, tolerance: float = TOLERANCE) -> int:
    """0 equal within a tolerance relative to ``a``, -1 different, -2 sizes differ; equal zeros are equal."""
    if size_a != size_b:
        return -2
    differ = (F.col("a") != F.col("b")) & ((F.col("a") == 0) | (F.abs((F.col("a") - F.col("b")) / F.col("a")) > tolerance))
    return 0 if _pair(a, b).where(differ).isEmpty() else -1


def gather(parts: DataFrame) -> DataFrame:
    """Partial results ``i, v`` added up."""
    return parts.groupBy("i").agg(F.sum("v").alias("v"))


def show(v: DataFrame, n: int = 20) -> str:
    return "[ " + " ".join(f"{r.v:g}" for r in v.orderBy("i").limit(n).collect()) + " ]"
