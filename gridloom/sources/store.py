"""Tuned matrices on disk: units as Parquet sorted by row, with their shape and permutation."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.model import ROWS_A_TASK
from gridloom.plans.encode import TunedMatrix


def save(t: TunedMatrix, path: str) -> None:
    spark = t.units.sparkSession
    enough = [] if t.most is None else [max(1, -(-t.most // ROWS_A_TASK))]
    t.units.repartitionByRange(*enough, "part", "row").sortWithinPartitions("part", "row", "col").write.parquet(f"{path}/units")
    spark.createDataFrame([(t.nrows, t.ncols, t.symmetric, t.perm is not None, t.parts is not None)], "nrows long, ncols long, symmetric boolean, permuted boolean, parted boolean").coalesce(1).write.parquet(f"{path}/meta")
    if t.perm is not None:
        t.perm.write.parquet(f"{path}/perm")
    if t.parts is not None:
        t.parts.coalesce(1).write.parquet(f"{path}/parts")


def restore(spark: SparkSession, path: str) -> TunedMatrix:
    m = spark.read.parquet(f"{path}/meta").first()
    read = lambda name, there: spark.read.parquet(f"{path}/{name}") if there else None
    return TunedMatrix(spark.read.parquet(f"{path}/units"), m.nrows, m.ncols, m.symmetric, read("perm", m.permuted), read("parts", m.parted))
