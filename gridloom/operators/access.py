"""Entry lookup and update, on matrices and on units."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from gridloom.errors import BoundsError, EntryNotFound, fail
from gridloom.model import Matrix
from gridloom.plans.encode import TunedMatrix, decode


def _place(t, i: int, j: int, base: int) -> tuple[int, int]:
    i, j = i - base, j - base
    if not (0 <= i < t.nrows and 0 <= j < t.ncols):
        fail(BoundsError(f"({i}, {j}) in {t.nrows} x {t.ncols}"))
    perm = getattr(t, "perm", None)
    if perm is not None:
        new = {r.old_i: r.new_i for r in perm.where(F.col("old_i").isin(i, j)).collect()}
        i, j = new[i], new[j]
    return i, j


def _hits(i: int, j: int):
    """Offset of (i, j) within a unit, null where the unit doesn't hold it."""
    row, col, d, n = F.col("row"), F.col("col"), F.col("inst"), F.col("size")
    align = F.substring("type", 3, 1).cast("long")
    down, right = F.lit(i) - row, F.lit(j) - col

    def on(steps, other):
        return F.when((other) & (steps % d == 0) & (steps >= 0) & (steps / d < n), (steps / d).cast("int"))

    place = F.when(down == 0, F.array_position(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.slice("deltas", F.lit(1), k), F.lit(0).cast("long"), lambda s, g: s + g)), right).cast("int") - 1)
    block_r = F.when((down >= 0) & (down < align) & (right >= 0) & (right * align + down < n), (right * align + down).cast("int"))
    block_c = F.when((right >= 0) & (right < align) & (down >= 0) & (down * align + right < n), (down * align + right).cast("int"))
    kind = F.col("type")
    return (
        F.when(kind == "none", F.when(place >= 0, place))
        .when(kind == "h", on(right, down == 0))
        .when(kind == "v", on(down, right == 0))
        .when(kind == "d", on(down, down == right))
        .when(kind == "ad", on(down, down == -right))
        .when(kind.startswith("br"), block_r)
        .otherwise(block_c)
    )


def get_entry(t: TunedMatrix | Matrix, i: int, j: int, base: int = 0) -> float:
    """Stored value; raises ``BoundsError`` or ``EntryNotFound``. Coordinates are the original ones."""
    i, j = _place(t, i, j, base)
    if isinstance(t, Matrix):
        rows = t.df.where((F.col("i") == i) & (F.col("j") == j)).select("v").limit(1).collect()
    else:
        found = t.units.where(F.col("row") <= i).withColumn("at", _hits(i, j)).where("at IS NOT NULL")
        rows = found.select(F.get("vals", F.col("at")).alias("v")).limit(1).collect()
    return rows[0].v if rows else fail(EntryNotFound(f"({i}, {j})"))


def set_entry(t: TunedMatrix | Matrix, i: int, j: int, value: float, base: int = 0):
    """The matrix with an existing entry changed; of a symmetric one its mirror too."""
    get_entry(t, i, j, base)
    i, j = _place(t, i, j, base)
    spots = {(i, j), (j, i)} if t.symmetric else {(i, j)}
    if isinstance(t, Matrix):
        here = F.lit(False)
        for r, c in spots:
            here = here | ((F.col("i") == r) & (F.col("j") == c))
        return dataclasses.replace(t, df=t.df.withColumn("v", F.when(here, F.lit(float(value))).otherwise(F.col("v"))))
    units = t.units
    for r, c in spots:
        at = _hits(r, c)
        units = units.withColumn("vals", F.when(at.isNotNull(), F.transform("vals", lambda x, k: F.when(k == at, F.lit(float(value))).otherwise(x))).otherwise(F.col("vals")))
    return dataclasses.replace(t, units=units)


def set_all(t: TunedMatrix, value: float) -> TunedMatrix:
    return dataclasses.replace(t, units=t.units.withColumn("vals", F.transform("vals", lambda x: F.lit(float(value)))))


def entries(t: TunedMatrix):
    return decode(t.units)
