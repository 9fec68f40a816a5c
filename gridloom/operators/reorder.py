"""Bandwidth-reducing reordering by reverse Cuthill-McKee, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.errors import NotReordered, fail, warn
from gridloom.model import Matrix


def _fix(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    out = df.persist()
    out.count()
    return out


def graph(a: Matrix) -> DataFrame:
    """Undirected edges ``s, t`` in both directions from off-diagonal entries."""
    e = a.df.where("i <> j").select(F.col("i").alias("s"), F.col("j").alias("t"))
    return e.unionByName(e.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()


def bandwidth(a: Matrix) -> DataFrame:
    return a.df.agg(F.coalesce(F.max(F.abs(F.col("i") - F.col("j"))), F.lit(0)).alias("bandwidth"))


def rcm(a: Matrix) -> DataFrame | None:
    """``old_i, new_i``, or None (with a warning) for a matrix without off-diagonal entries.

    Each component starts at its vertex of least degree. A level is ordered by the least rank
    of a vertex's parents, then degree, then number; ranks are reversed at the end. Only
    counts and the next start come to the driver.
    """
    edges = _fix(graph(a))
    if edges.isEmpty():
        warn("no off-diagonal entry, nothing to reorder")
        return None
    spark = a.df.sparkSession
    degree = spark.range(a.nrows).withColumnRenamed("id", "s").join(edges.groupBy("s").agg(F.count("*").alias("deg")), "s", "left").select("s", F.coalesce("deg", F.lit(0)).alias("deg"))
    degree = _fix(degree)
    # isolated vertices come in order of number, all at once
    alone = degree.where("deg = 0")
    ranked = _fix(alone.select("s", (F.row_number().over(W.orderBy("s")) - 1).cast("long").alias("rank")))
    done = ranked.count()
    while done < a.nrows:
        start = degree.join(ranked, "s", "left_anti").agg(F.min(F.struct("deg", "s"))).first()[0].s
        level = spark.createDataFrame([(start, done)], "s long, rank long")
        n = 1
        while n:
            ranked = _fix(ranked.unionByName(level))
            done += n
            parents = edges.join(level.select("s", "rank"), "s").groupBy(F.col("t").alias("s")).agg(F.min("rank").alias("parent"))
            fresh = parents.join(ranked, "s", "left_anti").join(degree, "s")
            level = _fix(fresh.select("s", (F.row_number().over(W.orderBy("parent", "deg", "s")) + (done - 1)).cast("long").alias("rank")))
            n = level.count()
    return ranked.select(F.col("s").alias("old_i"), (F.lit(a.nrows - 1) - F.col("rank")).alias("new_i"))


def permuted(a: Matrix, perm: DataFrame) -> Matrix:
    """Entries at ``(perm[i], perm[j])``."""
    r = perm.select(F.col("old_i").alias("i"), F.col("new_i").alias("ni"))
    c = perm.select(F.col("old_i").alias("j"), F.col("new_i").alias("nj"))
    return Matrix(a.df.join(r, "i").join(c, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v"), a.nrows, a.ncols, a.symmetric)


def permutation(tuned) -> DataFrame:
    return tuned.perm if tuned.perm is not None else fail(NotReordered())
