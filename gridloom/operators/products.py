"""Matrix-by-vector products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DimensionError, fail
from gridloom.model import Matrix, spread

#: Vectors of up to this many entries (16 bytes each) are broadcast; longer ones are shuffled by column.
BROADCAST_ENTRIES = 2_000_000


def _check(a: Matrix, x_size: int | None, y_size: int | None) -> None:
    if (x_size is not None and x_size != a.ncols) or (y_size is not None and y_size != a.nrows):
        fail(DimensionError(f"{a.nrows} x {a.ncols} by {x_size} into {y_size}"))


def _sums(entries: DataFrame, x: DataFrame, ncols: int, most: int | None = None) -> DataFrame:
    xs = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    if ncols <= BROADCAST_ENTRIES:
        xs = F.broadcast(xs)
    elif most is not None:
        entries = spread(entries, most, "j")
    return entries.join(xs, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))


def halves(a: Matrix) -> tuple[DataFrame, DataFrame]:
    """Strict lower triangle ``i, j, v`` and diagonal ``i, v`` of a symmetric matrix; a missing diagonal is 0."""
    return a.df.where("i > j"), a.df.where("i = j").select("i", "v")


def from_halves(lower: DataFrame, diagonal: DataFrame) -> DataFrame:
    mirrored = lower.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return lower.unionByName(mirrored).unionByName(diagonal.select("i", F.col("i").alias("j"), "v"))


def is_symmetric(a: Matrix) -> bool:
    sums = a.df.groupBy("i", "j").agg(F.sum("v").alias("v"))
    mirror = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return a.nrows == a.ncols and sums.join(mirror, ["i", "j"], "left").where("w IS NULL OR w <> v").isEmpty()


def _entries(a: Matrix) -> DataFrame:
    return from_halves(*halves(a)) if a.symmetric else a.df


def multiply(alpha: float, a: Matrix, x: DataFrame, x_size: int | None = None) -> DataFrame:
    """``y = alpha*A*x`` as ``i, v`` with a row for every row of the matrix, 0 where it is empty."""
    return kernel(alpha, a, x, 0.0, None, x_size)


def kernel(alpha: float, a: Matrix, x: DataFrame, beta: float, y: DataFrame | None, x_size: int | None = None, y_size: int | None = None) -> DataFrame:
    """``alpha*A*x + beta*y``. All rows are scaled by ``beta``, empty ones too."""
    _check(a, x_size, y_size)
    s = _sums(_entries(a), x, a.ncols, a.most)
    rows = a.df.sparkSession.range(a.nrows).withColumnRenamed("id", "i")
    ax = F.lit(float(alpha)) * F.coalesce("s", F.lit(0.0))
    out = rows.join(s, "i", "left")
    if beta == 0.0 or y is None:
        return out.select("i", ax.alias("v"))
    old = F.coalesce("old", F.lit(0.0))
    out = out.join(y.select("i", F.col("v").alias("old")), "i", "left")
    return out.select("i", (ax + (old if beta == 1.0 else F.lit(float(beta)) * old)).alias("v"))


def kernel_repeated(alpha: float, a: Matrix, x: DataFrame, beta: float, y: DataFrame, times: int) -> DataFrame:
    """``times`` applications of ``y <- alpha*A*x + beta*y`` in closed form: one product."""
    power = float(beta) ** times
    total = float(times) if beta == 1.0 else (1 - power) / (1 - float(beta))
    return kernel(alpha * total, a, x, power, y)


class LazyKernel:
    """Product from CSR arrays that builds and keeps its matrix at the first call."""

    def __init__(self, spark):
        self.spark, self.held = spark, None

    def __call__(self, nrows, ncols, rowptr, colind, values, alpha, x, beta, y) -> DataFrame:
        from gridloom.sources.csr import load_csr

        if self.held is None:
            self.held = load_csr(self.spark, rowptr, colind, values, nrows, ncols).persist()
        return kernel(alpha, self.held, x, beta, y)
