"""Matrices and vectors as DataFrames of coordinates, 0-based throughout."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError


#: Rows of a partition that a sort, window or hash table holds at once; tables of more get more partitions.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Partitions by ``keys``, as many as a table of up to ``rows`` rows needs.

    A fixed number of partitions, or partitions merged up to a size in compressed bytes, would let
    the memory of a task grow with the table.
    """
    if rows <= ROWS_A_TASK:
        return df.repartition(*keys)
    return df.repartition(max(-(-rows // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)


@dataclasses.dataclass(frozen=True)
class Matrix:
    """``df`` has ``i long, j long, v double``. Repeated coordinates add up in products. Missing ones are 0.

    If ``symmetric``, ``df`` holds the whole matrix all the same; products may use one triangle.
    ``most`` is a known bound on the rows of ``df``; ``distinct`` says that no coordinate is repeated.
    """

    df: DataFrame
    nrows: int
    ncols: int
    symmetric: bool = False
    most: int | None = None
    distinct: bool = False

    @property
    def nnz(self) -> int:
        return self.df.count()

    @property
    def bound(self) -> int:
        """Rows of ``df`` at most; counted if no bound is known."""
        return self.nnz if self.most is None else self.most

    def persist(self) -> Matrix:
        """Keep the matrix by row, so products against a broadcast vector need no shuffle."""
        return dataclasses.replace(self, df=self.df.repartition("i").persist())

    def unpersist(self) -> Matrix:
        self.df.unpersist()
        return self


def matrix(df: DataFrame, nrows: int, ncols: int, i: str = "i", j: str = "j", v: str = "v", base: int = 0, symmetric: bool = False, most: int | None = None, distinct: bool = False) -> Matrix:
    """Matrix from any coordinate table; ``base`` is 0 or 1."""
    kinds = dict(df.dtypes)
    if base not in (0, 1):
        raise ArgumentError("base is 0 or 1")
    if nrows < 0 or ncols < 0:
        raise ArgumentError("negative dimension")
    for c in (i, j):
        if kinds[c] not in ("tinyint", "smallint", "int", "bigint"):
            raise ArgumentError(f"{c} isn't an integer column")
    if kinds[v] not in ("float", "double"):
        raise ArgumentError(f"{v} isn't a floating-point column")
    shift = F.lit(base).cast("long")
    slim = df.select((F.col(i).cast("long") - shift).alias("i"), (F.col(j).cast("long") - shift).alias("j"), F.col(v).cast("double").alias("v"))
    return Matrix(slim, nrows, ncols, symmetric, most, distinct)
