"""Row partitions balanced by non-zeros, and the split of symmetric matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import GridloomError, fail
from gridloom.model import Matrix
from gridloom.sources.csr import row_pointers

SCHEMA = "part int, row_start long, row_end long, nnz long"


def _cuts(a: Matrix, parts: int, targets) -> DataFrame:
    """Each cut is the first row at which the running count reaches its target; targets may
    depend on the count at the cut before, so one small query runs for each part."""
    spark = a.df.sparkSession
    ptr = row_pointers(a).persist()
    nnz = ptr.agg(F.coalesce(F.max("stop"), F.lit(0))).first()[0]
    rows, start, done = [], 0, 0
    for k in range(parts):
        if k == parts - 1:
            end, stop = a.nrows, nnz
        else:
            at = ptr.where((F.col("stop") >= targets(k, done, nnz)) & (F.col("i") >= start)).agg(F.min(F.struct("i", "stop"))).first()[0]
            end, stop = (at.i + 1, at.stop) if at else (a.nrows, nnz)
        rows.append((k, start, end, stop - done))
        start, done = end, stop
    ptr.unpersist()
    return spark.createDataFrame(rows, SCHEMA)


def balanced(a: Matrix, parts: int) -> DataFrame:
    """``part, row_start, row_end, nnz``: whole rows until a part holds its share of what is left."""
    return _cuts(a, parts, lambda k, done, nnz: done + (nnz - done) // (parts - k))


def fixed(a: Matrix, parts: int) -> DataFrame:
    """The same with one share for all parts."""
    return _cuts(a, parts, lambda k, done, nnz: done + max(1, nnz // parts))


def with_parts(a: Matrix, parts: DataFrame) -> DataFrame:
    """Entries with their ``part``; the table of parts is a row per part."""
    p = F.broadcast(parts.select("part", "row_start", "row_end"))
    return a.df.join(p, (F.col("i") >= F.col("row_start")) & (F.col("i") < F.col("row_end"))).drop("row_end")


def bounds(units: DataFrame) -> DataFrame:
    """First and last row of each part of a unit table."""
    return units.groupBy("part").agg(F.min("row").alias("row_start"), (F.max("row") + 1).alias("row_end"))


def symmetric_split(a: Matrix, parts: DataFrame, full_diagonal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Strict lower entries with ``remote`` (column left of the part's rows), and the diagonal.

    A missing diagonal entry is 0 unless ``full_diagonal`` asks for all of them.
    """
    from gridloom.operators.products import is_symmetric

    if not is_symmetric(a):
        fail(GridloomError("the matrix isn't symmetric"))
    lower = with_parts(Matrix(a.df.where("i > j"), a.nrows, a.ncols), parts)
    diagonal = a.df.where("i = j").select("i", "v")
    if full_diagonal and diagonal.select("i").distinct().count() != a.nrows:
        fail(GridloomError("diagonal entries are missing"))
    return lower.withColumn("remote", F.col("j") < F.col("row_start")), diagonal
