"""Iteration orders: coordinate transforms as column expressions.

Coordinates here are 1-based, as the formulas of block orders are; ``a`` groups, ``b`` orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.options import alignment


def _div(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("long")


def forward(kind: str, r: Column, c: Column, n: int, m: int) -> tuple[Column, Column]:
    """(row, column) of an n x m matrix -> (a, b)."""
    if kind == "h":
        return r, c
    if kind == "v":
        return c, r
    if kind == "d":
        return F.lit(n) + c - r, F.least(r, c)
    if kind == "ad":
        k = r + c - 1
        return k, F.when(k <= m, r).otherwise(F.lit(m) - c + 1)
    size = alignment(kind)
    if kind.startswith("bc"):
        r, c = c, r
    return _div(r - 1, size) + 1, (r - 1) % size + size * (c - 1) + 1


def inverse(kind: str, a: Column, b: Column, n: int, m: int) -> tuple[Column, Column]:
    if kind == "h":
        return a, b
    if kind == "v":
        return b, a
    if kind == "d":
        return F.when(a < n, F.lit(n) + b - a).otherwise(b), F.when(a < n, b).otherwise(a + b - n)
    if kind == "ad":
        return F.when(a <= m, b).otherwise(a + b - m), F.when(a <= m, a - b + 1).otherwise(F.lit(m) - b + 1)
    size = alignment(kind)
    r, c = size * (a - 1) + (b - 1) % size + 1, _div(b - 1, size) + 1
    return (c, r) if kind.startswith("bc") else (r, c)


def between(old: str, new: str, a: Column, b: Column, n: int, m: int) -> tuple[Column, Column]:
    """From one order to another, through rows and columns."""
    return forward(new, *inverse(old, a, b, n, m), n, m)


def transformed(df: DataFrame, kind: str, n: int, m: int) -> DataFrame:
    """Adds ``a, b`` to a table of 0-based ``i, j``."""
    a, b = forward(kind, F.col("i") + 1, F.col("j") + 1, n, m)
    return df.withColumns({"a": a.cast("long"), "b": b.cast("long")})


def row_window(df: DataFrame, start: int, end: int, rebase: bool = True) -> DataFrame:
    """Rows [start, end) of a matrix, counted from the first of them."""
    cut = df.where((F.col("i") >= start) & (F.col("i") < end))
    return cut.withColumn("i", F.col("i") - start) if rebase else cut


def put_back(df: DataFrame, window: DataFrame, start: int, end: int) -> DataFrame:
    """Replaces rows [start, end) by a window counted from its first row."""
    rest = df.where((F.col("i") < start) | (F.col("i") >= end))
    return rest.unionByName(window.withColumn("i", F.col("i") + start))
