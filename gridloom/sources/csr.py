"""Compressed sparse rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError, fail
from gridloom.model import Matrix, matrix, spread


def load_csr(spark: SparkSession, rowptr, colind, values, nrows: int, ncols: int, base: int = 0) -> Matrix:
    """Matrix from three arrays held by the caller."""
    if rowptr is None or colind is None or values is None or nrows < 0 or ncols < 0:
        return fail(ArgumentError("arrays and dimensions must be given"))
    if base not in (0, 1) or len(rowptr) != nrows + 1 or rowptr[nrows] - base != len(colind):
        return fail(ArgumentError("row pointers don't fit"))
    one = spark.createDataFrame([([int(x) - base for x in rowptr], [int(x) for x in colind], [float(x) for x in values])], "p array<bigint>, c array<bigint>, v array<double>")
    return matrix(expand(one, base), nrows, ncols)


def expand(arrays: DataFrame, base: int = 0) -> DataFrame:
    """``i, j, v`` of rows ``p, c, v`` with 0-based row pointers."""
    rows = arrays.select("c", "v", F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("i", "stop"), "p")
    cut = F.get("p", F.col("i"))
    n = (F.col("stop") - cut).cast("int")
    part = F.arrays_zip(F.slice("c", (cut + 1).cast("int"), n).alias("c"), F.slice("v", (cut + 1).cast("int"), n).alias("v"))
    return rows.where(n > 0).select(F.col("i").cast("long").alias("i"), F.explode(part).alias("e")).select("i", (F.col("e.c") - F.lit(base)).alias("j"), "e.v")


def row_pointers(a: Matrix) -> DataFrame:
    """``i, n, stop``: entries of each row and of all rows up to it, empty rows included.

    The running sum is taken in two steps, within blocks of rows and over blocks.
    """
    rows = a.df.sparkSession.range(a.nrows).withColumnRenamed("id", "i")
    counts = rows.join(a.df.groupBy("i").count(), "i", "left").select("i", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
    blocked = counts.withColumn("b", F.floor(F.col("i") / 65536))
    over = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    before = blocked.groupBy("b").agg(F.sum("n").alias("t")).select("b", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("before"))
    run = F.sum("n").over(W.partitionBy("b").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return spread(blocked, a.nrows, "b").withColumn("run", run).join(before, "b").select("i", "n", (F.col("before") + F.col("run")).alias("stop"))


def to_csr(a: Matrix) -> tuple[DataFrame, DataFrame]:
    """Row pointers, and entries ``pos, j, v`` in row order; a position is found within its row."""
    ptr = row_pointers(a)
    place = F.row_number().over(W.partitionBy("i").orderBy("j", "v"))
    entries = a.df.withColumn("k", place).join(ptr, "i").select((F.col("stop") - F.col("n") + F.col("k") - 1).alias("pos"), "j", "v")
    return ptr, entries


def get_value(a: Matrix, i: int, j: int) -> float:
    """The first stored value at a coordinate; 0 where none is."""
    row = a.df.where((F.col("i") == i) & (F.col("j") == j)).agg(F.min("v")).first()[0]
    return 0.0 if row is None else row
