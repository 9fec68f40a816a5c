"""Encoding of substructures into units, and everything done from units.

A unit table has a row per unit: ``part, row, col`` (0-based place of the first element),
``type`` (``none`` for single elements with their column gaps), ``inst``, ``size``,
``deltas`` and ``vals``. Encoding works on groups of one iteration order: each is a row, column,
diagonal or band of rows, never the matrix; Arrow function calls handle many of them at once.
"""

from __future__ import annotations

import dataclasses
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.xform import inverse, transformed
from gridloom.model import Matrix, spread
from gridloom.options import LINEAR, TYPE_ORDER, Options, alignment, parse_types
from gridloom.plans import mining

MAX_SINGLE = 255
#: Elements of an Arrow function call, unless a group has more.
CHUNK = 65_536


def lcm(a: int, b: int) -> int:
    return a // gcd(a, b) * b


def _groups(batches, keys: tuple[str, ...], cut):
    """``cut`` of tables of whole groups, from batches sorted by ``keys``; many groups go into one call."""
    held, rows, need = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < need:
            continue
        x = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for k in keys:
            c = x.column(k).to_numpy()
            last &= c == c[-1]
        start = 0 if last.all() else rows - int(np.argmin(last[::-1]))
        if start:
            yield from cut(x.slice(0, start)).to_batches()
        held, rows = x.slice(start).to_batches(), rows - start
        need = max(CHUNK, 2 * rows)
    if rows:
        yield from cut(pa.Table.from_batches(held).combine_chunks()).to_batches()


def _first(x: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Which rows begin a group."""
    new = np.ones(x.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = x.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return new


def _linear_units(b: np.ndarray, new: np.ndarray, strides: set[int], lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Units (begin, size, stride) among the sorted positions of groups, whose first ones ``new`` marks.

    Runs of equal gaps share an element with the next run, which has it if it is in no unit."""
    gap = b[1:] - b[:-1]
    if not len(gap):
        return []
    cross = new[1:]  # a gap to another group is a run of its own
    change = np.ones(len(gap), bool)
    change[1:] = (gap[1:] != gap[:-1]) | cross[1:] | cross[:-1]
    at = np.flatnonzero(change)
    size = np.diff(np.append(at, len(gap))) + 1
    may = ~cross[at] & (size >= lo) & np.isin(gap[at], np.fromiter(strides, np.int64, len(strides)))
    out, free = [], 0
    for begin, left, stride in zip(at[may].tolist(), size[may].tolist(), gap[at[may]].tolist()):
        used = max(begin, free)
        left -= used - begin
        while left >= lo:
            take = min(left, hi)
            out.append((used, take, stride))
            used += take
            left -= take
            free = used
    return out


def _block_units(b: np.ndarray, new: np.ndarray, align: int, dims: list[int], split: bool, hi: int) -> list[tuple[int, int, int]]:
    """Units (begin, size, other dimension) from runs of consecutive positions, widest selected first."""
    dims = sorted((d for d in dims if d >= 2 and d * align <= hi), reverse=True)
    change = new.copy()
    change[1:] |= b[1:] != b[:-1] + 1
    at = np.flatnonzero(change)
    skip = (align - (b[at] - 1) % align) % align
    whole = (np.diff(np.append(at, len(b))) - skip) // align
    may = whole >= 2
    out = []
    for begin, left in zip((at + skip)[may].astype(int).tolist(), whole[may].astype(int).tolist()):
        if split:
            for d in dims:
                while left >= d:
                    out.append((begin, d * align, d))
                    begin += d * align
                    left -= d
        else:
            most = hi // align
            while left >= 2:
                d = min(left, most)
                out.append((begin, d * align, d))
                begin += d * align
                left -= d
    return out


def _sorted(t: DataFrame, most: int, *keys: str) -> DataFrame:
    return spread(t, most, *keys[:-1]).sortWithinPartitions(*keys)


def encode_type(singles: DataFrame, kind: str, insts: list[int], n: int, m: int, options: Options, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Units of one type and the elements left. ``singles`` is ``part, i, j, v`` without repeated
    coordinates, of ``most`` rows at most; they are counted without it."""
    align = alignment(kind)
    t = transformed(singles, kind, n, m).select("part", "a", "b", "v")
    lo, hi, split = options.min_unit, options.max_unit, options.split_blocks
    wanted = set(insts)

    def cut(x):
        b, new = x.column("b").to_numpy(), _first(x, ("part", "a"))
        # runs of elements encoded before are gaps in b and part the stream by themselves
        units = _linear_units(b, new, wanted, lo, hi) if kind in LINEAR else _block_units(b, new, align, sorted(wanted), split, hi)
        s, size, inst = np.array(units, np.int64).reshape(-1, 3).T
        inside = np.zeros(len(b) + 1, np.int64)
        np.add.at(inside, s + 1, 1)
        np.add.at(inside, s + size, -1)
        begin = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        insts_at, sizes = np.zeros((2, len(b)), np.int64)
        insts_at[s], sizes[s] = inst, size
        held = np.flatnonzero(np.repeat(sizes[begin] > 0, np.diff(np.append(begin, len(b)))))
        ends = np.append(0, np.cumsum(sizes[begin]))
        vals = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _flat(x, "v").take(pa.array(held)))
        at = x.select(["part", "a", "b", "v"]).take(begin)
        return at.append_column("inst", pa.array(insts_at[begin])).append_column("vals", vals)

    done = _sorted(t, singles.count() if most is None else most, "part", "a", "b").mapInArrow(lambda batches: _groups(batches, ("part", "a"), cut), "part int, a long, b long, v double, inst long, vals array<double>")
    r, c = inverse(kind, F.col("a"), F.col("b"), n, m)
    out = _kept(done.select("part", (r - 1).cast("long").alias("row"), (c - 1).cast("long").alias("col"), "v", "inst", "vals"))
    units = out.where("inst > 0").select("part", "row", "col", F.lit(kind).alias("type"), "inst", F.size("vals").alias("size"), F.array().cast("array<int>").alias("deltas"), "vals")
    return units, out.where("inst = 0").select("part", F.col("row").alias("i"), F.col("col").alias("j"), "v")


def _flat(x: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    c = x.column(name)
    return pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)


def _row_units(x: pa.Table) -> pa.Table:
    j, new = x.column("j").to_numpy(), _first(x, ("part", "i"))
    n = len(j)
    head = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    first = place % MAX_SINGLE == 0
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    gap = np.zeros(n, np.int64)
    gap[1:] = j[1:] - j[:-1]
    gap[first] = 0
    widest = np.maximum.reduceat(gap, begin)
    inst = 8 * np.where(widest < 256, 1, np.where(widest < 65536, 2, np.where(widest < 2**32, 4, 8)))
    deltas = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size - 1)), pa.int32()), pa.array(gap[~first]).cast(pa.int32()))
    vals = pa.ListArray.from_arrays(pa.array(np.append(begin, n), pa.int32()), _flat(x, "v"))
    at = x.select(["part", "i", "j"]).take(begin)
    return pa.table([*at.columns, pa.array(inst, pa.int64()), pa.array(size, pa.int32()), deltas, vals], ["part", "row", "col", "inst", "size", "deltas", "vals"])


def single_units(singles: DataFrame, most: int | None = None) -> DataFrame:
    """Elements of a row in units of at most 255 with their column gaps."""
    rows = _sorted(singles.select("part", "i", "j", "v"), singles.count() if most is None else most, "part", "i", "j")
    out = rows.mapInArrow(lambda batches: _groups(batches, ("part", "i"), _row_units), "part int, row long, col long, inst long, size int, deltas array<int>, vals array<double>")
    return out.select("part", "row", "col", F.lit("none").alias("type"), "inst", "size", "deltas", "vals")


@dataclasses.dataclass(frozen=True)
class TunedMatrix:
    """Units of a matrix, the permutation of its rows and columns if it was reordered, its row parts,
    a bound on its elements if known."""

    units: DataFrame
    nrows: int
    ncols: int
    symmetric: bool = False
    perm: DataFrame | None = None
    parts: DataFrame | None = None
    most: int | None = None

    @property
    def nnz(self) -> int:
        return self.units.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _merged(a: Matrix) -> DataFrame:
    return a.df if a.distinct else spread(a.df, a.bound, "i", "j").groupBy("i", "j").agg(F.sum("v").alias("v"))


def tune(a: Matrix, options: Options | None = None, reorder: bool = False) -> TunedMatrix:
    """Encode a matrix: greedily, the best-scoring type of each round, or as an explicit list asks.

    Repeated coordinates are added up first. A list of types with strides or widths is encoded in
    its order without statistics. Statistics are of all elements not yet encoded.
    """
    from gridloom.operators.partition import balanced, with_parts
    from gridloom.operators.reorder import permuted, rcm

    options = options or Options()
    perm = None
    if reorder:
        perm = rcm(a)
        a = permuted(a, perm) if perm is not None else a
    clean = dataclasses.replace(a, df=_kept(_merged(a)), distinct=True)
    parts = balanced(clean, options.parts)
    singles = with_parts(clean, parts).select("part", "i", "j", "v")
    total = singles.count()
    explicit = {t: d for t, d in parse_types(options.types).items() if d}
    found = []
    if explicit:
        plan = list(explicit.items())
        for kind, insts in plan:
            units, singles = encode_type(singles, kind, list(insts), a.nrows, a.ncols, options, total)
            found.append(units)
    else:
        open_ = mining.wanted_types(options)
        while open_:
            coords = singles.select("part", "i", "j")
            rows = mining.all_stats(coords, a.nrows, a.ncols, options, open_, total).groupBy("type", "inst").agg(F.sum("nnz").alias("nnz"), F.sum("pat").alias("pat")).collect()  # by type and instance
            stats = {(r.type, r.inst): mining.Stat(r.nnz, r.pat) for r in rows}
            if options.split_blocks:
                stats = mining.split_blocks(stats, total, options)
            stats = {k: s for k, s in stats.items() if s.nnz >= options.min_coverage * total}
            scores = {}
            for (kind, _), s in stats.items():
                gain = s.nnz - s.pat - (s.pat if options.heuristic == "cost" else 0)
                scores[kind] = scores.get(kind, 0) + gain
            best = max((t for t in open_ if scores.get(t, 0) > 0), key=lambda t: (scores[t], -TYPE_ORDER[t]), default=None)
            if best is None:
                break
            units, singles = encode_type(singles, best, [i for k, i in stats if k == best], a.nrows, a.ncols, options, total)
            found.append(units)
            open_ = [t for t in open_ if t != best and scores.get(t, 0) > 0]
    out = single_units(singles, total)
    for units in found:
        out = out.unionByName(units)
    return TunedMatrix(out, a.nrows, a.ncols, a.symmetric, perm, parts, total)


def _has_checkpoint(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if _has_checkpoint(df) else df.persist()


def decode(units: DataFrame) -> DataFrame:
    """Elements ``i, j, v`` of units."""
    return units.select("row", "col", "type", "inst", "deltas", "vals").mapInArrow(_elements, "i long, j long, v double")


def _elements(batches):
    for batch in batches:
        size = pc.list_value_length(batch.column("vals")).to_numpy()
        slot = np.cumsum(size) // CHUNK
        edges = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(size)]
        for s, e in zip(edges, edges[1:]):
            yield _places(batch.slice(s, e - s), size[s:e])


def _places(x: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
    """Elements of a few units: all steps from a unit's first element at once, type by type."""
    row, col, d, kind = (x.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "inst", "type"))
    unit = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    k = np.arange(len(unit)) - begin[unit]
    down, right = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
    for name in set(kind.tolist()):
        at = np.flatnonzero((kind == name)[unit])
        s, inst, align = k[at], d[unit[at]], alignment(name)
        if name == "none":
            gap = np.zeros(len(unit), np.int64)
            gap[at[s > 0]] = pc.list_flatten(x.column("deltas").filter(pa.array(kind == name))).to_numpy()
            walked = np.cumsum(gap)
            right[at] = walked[at] - walked[begin[unit[at]]]
        elif align:
            down[at], right[at] = (s % align, s // align) if name.startswith("br") else (s // align, s % align)
        else:
            down[at] = 0 if name == "h" else s * inst
            right[at] = 0 if name == "v" else s * inst * (-1 if name == "ad" else 1)
    return pa.RecordBatch.from_arrays([pa.array(row[unit] + down), pa.array(col[unit] + right), pc.list_flatten(x.column("vals"))], ["i", "j", "v"])


def to_matrix(t: TunedMatrix) -> Matrix:
    return Matrix(decode(t.units), t.nrows, t.ncols, t.symmetric, t.most, True)


def multiply_units(alpha: float, t: TunedMatrix, x: DataFrame) -> DataFrame:
    """Product straight from the units; with a reordered matrix ``x`` and the result are in new order."""
    from gridloom.operators.products import multiply

    return multiply(alpha, to_matrix(t), x)


def pattern_ids(units: DataFrame) -> DataFrame:
    """``type, inst, id, flag, npatterns, nnz``: a pattern's number, and its dense one among those in use."""
    order = F.create_map(*[F.lit(x) for p in TYPE_ORDER.items() for x in p])
    by = units.groupBy("type", "inst").agg(F.count("*").alias("npatterns"), F.sum("size").cast("long").alias("nnz"))
    by = by.withColumn("id", F.when(F.col("type") == "none", F.col("inst")).otherwise(F.element_at(order, F.col("type")) * 10000 + F.col("inst")).cast("long"))
    return by.withColumn("flag", F.dense_rank().over(W.orderBy("id")) - 1)  # a row per pattern in use


def varint_bytes(x):
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).when(x < 1 << 35, 5).otherwise(9)


def compressed_size(t: TunedMatrix, value_bytes: int = 8) -> DataFrame:
    """``value_bytes, index_bytes``: values, and per unit two bytes of flags and size, a row jump
    if rows are skipped, the column as a varint against the unit before, and gaps in their width."""
    gaps = F.when(F.col("type") == "none", F.size("deltas") * F.col("inst") / 8).otherwise(0)
    units = t.units.select("part", "row", "col", "size", gaps.alias("gaps"))
    units = spread(units, units.count() if t.most is None else t.most, "part", "row")
    col = F.col("col") - F.coalesce(F.lag("col").over(W.partitionBy("part", "row").orderBy("col")), F.lit(0))
    rows = units.withColumn("ctl", F.lit(2) + varint_bytes(F.greatest(col, F.lit(0))) + F.col("gaps")).groupBy("part", "row").agg(F.sum("size").alias("n"), F.sum("ctl").alias("ctl"))
    # the row before is found within blocks of rows, that of a block's first row over blocks
    rows = spread(rows.withColumn("b", F.floor(F.col("row") / 65536)), t.nrows, "part", "b")
    jumped = lambda row, before: F.when(row - before > 1, varint_bytes(row - before - 1)).otherwise(0)
    inner = F.lag("row").over(W.partitionBy("part", "b").orderBy("row"))
    blocks = rows.withColumn("ctl", F.col("ctl") + jumped(F.col("row"), inner)).groupBy("part", "b").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.sum("n").alias("n"), F.sum("ctl").alias("ctl"))
    above = F.coalesce(F.lag("hi").over(W.partitionBy("part").orderBy("b")), F.lit(-1))  # a row per block
    sized = blocks.withColumn("ctl", F.col("ctl") + jumped(F.col("lo"), above)).agg(F.sum("n").alias("n"), F.sum("ctl").cast("long").alias("index_bytes"))
    extra = t.nrows if t.symmetric else 0
    return sized.select(((F.col("n") + extra) * value_bytes).cast("long").alias("value_bytes"), "index_bytes")


def row_span(units: DataFrame) -> DataFrame:
    """``row, span``: how many rows below it the units that start in a row reach."""
    align = F.substring("type", 3, 1).cast("long")
    reach = F.when(F.col("type").isin("v", "d", "ad"), (F.col("size") - 1) * F.col("inst")).when(F.col("type").startswith("br"), align - 1).when(F.col("type").startswith("bc"), F.col("inst") - 1).otherwise(0)
    return units.groupBy("row").agg(F.max(reach).cast("long").alias("span"))


def row_info(t: TunedMatrix) -> DataFrame:
    """``row, first``: values stored before the row's first unit; a row without units repeats the next."""
    rows = t.units.sparkSession.range(t.nrows).withColumnRenamed("id", "row")
    n = rows.join(t.units.groupBy("row").agg(F.sum("size").alias("n")), "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("row") / 65536).alias("b"))
    before = n.groupBy("b").agg(F.sum("n").alias("t")).select("b", F.coalesce(F.sum("t").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.sum("n").over(W.partitionBy("b").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    return spread(n, t.nrows, "b").withColumn("run", run).join(before, "b").select("row", (F.col("before") + F.col("run") - F.col("n")).cast("long").alias("first"))
