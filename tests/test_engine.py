"""Sparse-matrix operators against plain Python on small matrices, and the negative cases."""

import random
import re

import pytest

from gridloom import catalog, errors, model
from gridloom.functions import xform
from gridloom.operators import access, partition, products, reorder, vectors
from gridloom.options import Options, format_types, from_environment, parse_types, set_option
from gridloom.plans import encode, mining
from gridloom.sources import csr, market, store


def make(spark, entries, n, m, symmetric=False):
    return model.Matrix(spark.createDataFrame(entries, "i long, j long, v double"), n, m, symmetric)


def blocky(seed=1, n=12, m=15):
    rng = random.Random(seed)
    cells = {(i, i): 1.0 + i for i in range(n)}
    cells |= {(2, j): 0.5 * j for j in range(1, 9)} | {(i, 4): 2.0 * i for i in range(3, 11)}
    cells |= {(i, j): 3.0 for i in range(6, 10) for j in range(8, 13)} | {(i, 11 - i): 1.5 for i in range(9)}
    cells |= {(rng.randrange(n - 1), rng.randrange(m)): rng.random() for _ in range(25)}
    return [(i, j, v) for (i, j), v in sorted(cells.items()) if i != 5]  # row 5 is empty


def dense(df):
    return {(r.i, r.j): r.v for r in df.collect()}


def as_list(v):
    return [r.v for r in v.orderBy("i").collect()]


def product(entries, n, x):
    y = [0.0] * n
    for i, j, v in entries:
        y[i] += v * x[j]
    return y


def test_products_with_repeats_and_empty_rows(spark):
    e = blocky() + [(2, 3, 4.0), (2, 3, 4.0)]
    a, x = make(spark, e, 12, 15), [float(k + 1) for k in range(15)]
    xv, y0 = vectors.from_buffer(spark, x), vectors.from_buffer(spark, range(12))
    want = product(e, 12, x)
    assert as_list(products.multiply(0.5, a, xv)) == pytest.approx([0.5 * y for y in want])
    assert as_list(products.kernel(0.8, a, xv, 0.42, y0)) == pytest.approx([0.8 * y + 0.42 * k for k, y in enumerate(want)])
    y = list(map(float, range(12)))
    for _ in range(5):
        y = [0.8 * p + 0.42 * q for p, q in zip(want, y)]
    assert as_list(products.kernel_repeated(0.8, a, xv, 0.42, y0, 5)) == pytest.approx(y)
    with pytest.raises(errors.DimensionError):
        products.multiply(1.0, a, xv, x_size=14)


def test_symmetric_equals_general(spark):
    half = [(i, j, float(i + 2 * j)) for i, j, _ in blocky() if j < i]
    e = half + [(j, i, v) for i, j, v in half] + [(0, 0, 2.0)]
    x = vectors.from_buffer(spark, range(15))
    one = products.multiply(2.0, make(spark, e, 15, 15), x)
    two = products.multiply(2.0, make(spark, e, 15, 15, True), x)
    assert as_list(one) == pytest.approx(as_list(two))
    with pytest.raises(errors.GridloomError):
        partition.symmetric_split(make(spark, [(0, 1, 1.0)], 2, 2), spark.createDataFrame([(0, 0, 2)], "part int, row_start long, row_end long"))


def test_csr_round_trip_and_bases(spark):
    e = blocky()
    ptr = [0]
    for i in range(12):
        ptr.append(ptr[-1] + sum(r == i for r, _, _ in e))
    a = csr.load_csr(spark, ptr, [j for _, j, _ in e], [v for *_, v in e], 12, 15)
    assert dense(a.df) == {(i, j): v for i, j, v in e}
    b = csr.load_csr(spark, [p + 1 for p in ptr], [j + 1 for _, j, _ in e], [v for *_, v in e], 12, 15, base=1)
    assert dense(b.df) == dense(a.df)
    assert [r.stop for r in csr.row_pointers(a).orderBy("i").collect()] == ptr[1:]
    assert csr.get_value(a, 5, 5) == 0.0
    with pytest.raises(errors.ArgumentError):
        csr.load_csr(spark, None, [], [], 1, 1)


@pytest.mark.parametrize("kind", ["h", "v", "d", "ad", "br1", "br3", "br8", "bc2", "bc5"])
def test_transforms_invert(spark, kind):
    from pyspark.sql import functions as F

    t = xform.transformed(make(spark, blocky(), 12, 15).df, kind, 12, 15)
    r, c = xform.inverse(kind, F.col("a"), F.col("b"), 12, 15)
    assert t.where((r != F.col("i") + 1) | (c != F.col("j") + 1)).isEmpty()


def _linear(groups, lo, hi):
    """The rule for runs, one after another."""
    out = {}
    for bs in groups:
        ks = [b - p for p, b in zip([0, *bs], bs)]
        run = []
        for k in ks:
            if run and run[-1][0] == k:
                run[-1][1] += 1
            else:
                run.append([k, 1])
        rejected = False
        for q, (k, f) in enumerate(run):
            bonus = int(q > 0 and rejected)
            ok = f > 1 and f >= lo - bonus
            if ok:
                n = f + bonus
                nnz = n - (n % hi if n % hi < lo else 0)
                pats = n // hi + (n % hi >= lo)
                a, b = out.get(k, (0, 0))
                out[k] = a + nnz, b + pats
            rejected = not ok
    return out


@pytest.mark.parametrize("lo,hi", [(4, 255), (3, 5), (2, 4)])
def test_linear_statistics(spark, lo, hi):
    rng = random.Random(lo)
    groups = [sorted(rng.sample(range(1, 60), 35)) for _ in range(6)]
    t = spark.createDataFrame([(a, b) for a, bs in enumerate(groups) for b in bs], "a long, b long")
    got = {r.inst: (r.nnz, r.pat) for r in mining.linear_stats(t, Options(min_unit=lo, max_unit=hi)).collect()}
    assert got == _linear(groups, lo, hi)


def test_rollup_has_an_overall_row(spark):
    stats = spark.createDataFrame([("h", 1, 8, 2), ("h", 3, 4, 1), (None, None, 5, 1)], "type string, inst long, nnz long, pat long")
    got = sorted(map(tuple, mining.rollup(stats).collect()), key=str)
    assert got == sorted([("h", 1, 8, 2, 0), ("h", 3, 4, 1, 0), (None, None, 5, 1, 0), ("h", None, 12, 3, 1), (None, None, 5, 1, 1), (None, None, 17, 4, 2)], key=str)
    assert list(map(tuple, mining.rollup(stats.where("false")).collect())) == [(None, None, None, None, 2)]


def _fewest(df, key):
    """Partitions of the exchanges by this column, the fewest."""
    return min(int(n) for cols, n in re.findall(r"hashpartitioning\(([^()]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString()) if re.search(rf"\b{key}#", cols))


@pytest.mark.parametrize("name", ["stats_h", "stats_v", "stats_d", "stats_ad", "stats_br2", "stats_scaled", "stats_merge", "stats_rollup", "type_scores", "type_scores_cost", "choose_type", "coverage_filter", "rle_runs"])
def test_mining_tasks_stay_small(spark, monkeypatch, name):
    monkeypatch.setattr(model, "ROWS_A_TASK", 500, raising=False)
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert _fewest(df, "a") >= 12 and _fewest(df, "l_suppkey") >= 12  # 6,000 line items; the session has 4 partitions


def test_encoding_tasks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(model, "ROWS_A_TASK", 15, raising=False)
    e = blocky()
    t = encode.tune(make(spark, e, 12, 15), Options(sampling="none", types="h", min_coverage=0.01))
    n = -(-len(e) // 15)
    assert n > 4 and t.units.rdd.getNumPartitions() >= 2 * n and _fewest(encode.compressed_size(t), "row") >= n


def test_saved_and_multiplied_units_are_spread(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "ROWS_A_TASK", 15, raising=False)
    monkeypatch.setattr(model, "ROWS_A_TASK", 15, raising=False)
    monkeypatch.setattr(products, "BROADCAST_ENTRIES", 1)
    t = encode.tune(make(spark, blocky(), 12, 15), Options(sampling="none", types="d{1}"))
    store.save(t, str(tmp_path / "m"))
    n = -(-len(blocky()) // 15)
    assert n > 4 and len(list((tmp_path / "m" / "units").glob("*.parquet"))) > 4
    y = encode.multiply_units(0.5, t, vectors.from_buffer(spark, range(15)))
    assert _fewest(y, "j") >= n and as_list(y) == pytest.approx([0.5 * v for v in product(blocky(), 12, list(range(15)))])


def test_compressed_size_over_blocks_of_rows(spark):
    e = blocky() + [(2, 70000 + j, 1.0) for j in range(300)] + [(140000 + 3 * i, 7 + i, 2.0) for i in range(40)]
    t = encode.tune(make(spark, e, 150000, 80000), Options(sampling="none", types="h", parts=2, min_coverage=0.01))
    assert dense(encode.decode(t.units)) == pytest.approx({(i, j): v for i, j, v in e})
    sized = encode.compressed_size(t)
    bytes_, last = 0, {}
    size = lambda x: next(k for k in (1, 2, 3, 4) if x < 1 << 7 * k)
    for u in sorted(t.units.collect(), key=lambda u: (u.part, u.row, u.col)):
        row, col = last.get(u.part, (-1, 0))
        bytes_ += 2 + (size(u.row - row - 1) if u.row > row + 1 else 0) + size(u.col - col if u.row == row else u.col) + (len(u.deltas) * u.inst // 8 if u.type == "none" else 0)
        last[u.part] = u.row, u.col
    assert tuple(sized.first()) == (8 * len(e), bytes_)


def _one_after_another(b, strides, lo, hi):
    """The rule for units of one group."""
    out, at = [], 0
    while at < len(b) - 1:
        stride, stop = b[at + 1] - b[at], at + 1
        while stop < len(b) - 1 and b[stop + 1] - b[stop] == stride:
            stop += 1
        used, size = at, stop - at + 1
        while stride in strides and size >= lo:
            out.append((used, min(size, hi), stride))
            used += min(size, hi)
            size -= min(size, hi)
        at = used if used > at else stop
    return out


@pytest.mark.parametrize("lo,hi", [(4, 255), (3, 5), (2, 4)])
def test_many_groups_are_cut_in_one_call(monkeypatch, lo, hi):
    import pyarrow as pa

    rng = random.Random(hi)
    groups = [sorted(rng.sample(range(1, 60), rng.randrange(1, 45))) for _ in range(500)]
    x = pa.table({"part": [0 for bs in groups for _ in bs], "a": [a for a, bs in enumerate(groups) for _ in bs], "b": [b for bs in groups for b in bs]})
    got, calls = [], []

    def cut(t):
        calls.append(t.num_rows)
        got.extend((t.column("a")[s].as_py(), t.column("b")[s].as_py(), size, d) for s, size, d in encode._linear_units(t.column("b").to_numpy(), encode._first(t, ("part", "a")), {1, 2, 3}, lo, hi))
        return t

    monkeypatch.setattr(encode, "CHUNK", 1000)
    assert sum(b.num_rows for b in encode._groups(x.to_batches(max_chunksize=70), ("part", "a"), cut)) == x.num_rows
    assert got == [(a, bs[s], size, d) for a, bs in enumerate(groups) for s, size, d in _one_after_another(bs, {1, 2, 3}, lo, hi)]
    assert len(calls) < 20


@pytest.mark.parametrize(
    "options",
    [
        Options(sampling="none", min_coverage=0.01),
        Options(sampling="none", types="br2{2,3},bc3{2},d{1},h{1}"),
        Options(sampling="none", types="h,v", parts=3, heuristic="cost", split_blocks=False),
    ],
)
def test_units_decode_to_the_matrix(spark, tmp_path, options):
    a = make(spark, blocky(), 12, 15)
    t = encode.tune(a, options)
    assert dense(encode.decode(t.units)) == pytest.approx(dense(a.df))
    x = vectors.from_buffer(spark, range(15))
    assert as_list(encode.multiply_units(0.5, t, x)) == pytest.approx(as_list(products.multiply(0.5, a, x)))
    store.save(t, str(tmp_path / "m"))
    back = store.restore(spark, str(tmp_path / "m"))
    assert dense(encode.decode(back.units)) == pytest.approx(dense(a.df))
    assert access.get_entry(t, 2, 3) == dense(a.df)[2, 3]
    assert access.get_entry(access.set_entry(t, 7, 9, 0.42), 7, 9) == 0.42
    assert {r.v for r in encode.decode(access.set_all(t, 0.42).units).collect()} == {0.42}
    with pytest.raises(errors.EntryNotFound):
        access.get_entry(t, 5, 0)
    with pytest.raises(errors.BoundsError):
        access.get_entry(t, 12, 0)


def test_partition_and_reorder(spark):
    a = make(spark, [(i, i, 1.0) for i in range(10)], 10, 10)
    assert [(r.row_start, r.row_end, r.nnz) for r in partition.balanced(a, 3).orderBy("part").collect()] == [(0, 3, 3), (3, 6, 3), (6, 10, 4)]
    assert mining.pick_windows(10, 20) == list(range(10)) and mining.pick_windows(10, 2) == [3, 6]
    with pytest.warns(errors.GridloomWarning):
        assert reorder.rcm(a) is None
    order = [3, 0, 5, 1, 4, 2]
    chain = [(order[k], order[k + 1], 1.0) for k in range(5)]
    c = make(spark, chain + [(j, i, v) for i, j, v in chain], 7, 7)
    perm = reorder.rcm(c)
    assert sorted(r.new_i for r in perm.collect()) == list(range(7))
    assert reorder.bandwidth(reorder.permuted(c, perm)).first()[0] == 1
    x = vectors.from_buffer(spark, range(7))
    y = products.multiply(1.0, reorder.permuted(c, perm), vectors.reorder(x, perm))
    assert as_list(vectors.inverse_reorder(y, perm)) == as_list(products.multiply(1.0, c, x))


def _file(tmp_path, text):
    (tmp_path / "m.mtx").write_text(text)
    return str(tmp_path / "m.mtx")


def test_market_files(spark, tmp_path):
    a = market.load_market(spark, _file(tmp_path, "% plain\n2 3 3\n1 1 1.5\n1 3 2\n2\t2  -1"))
    assert dense(a.df) == {(0, 0): 1.5, (0, 2): 2.0, (1, 1): -1.0} and (a.nrows, a.ncols) == (2, 3)
    s = market.load_market(spark, _file(tmp_path, "%%MatrixMarket matrix coordinate real symmetric 0-base row\n2 2 2\n0 0 1\n1 0 4\n"))
    assert dense(s.df) == {(0, 0): 1.0, (1, 0): 4.0, (0, 1): 4.0} and s.symmetric
    market.save_market(a, str(tmp_path / "out"))
    assert dense(market.load_market(spark, str(tmp_path / "out")).df) == dense(a.df)


@pytest.mark.parametrize(
    "text",
    [
        "2 2 2\n2 1 1\n1 1 1\n",
        "2 2 3\n1 1 1\n2 2 1\n",
        "2 2 1\n1 1\n",
        "2 2 1\n3 1 1\n",
        "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 0\n",
        "%%MatrixMarket matrix array real general\n1 1\n1\n",
    ],
)
def test_bad_market_files(spark, tmp_path, text):
    with pytest.raises(errors.FormatError):
        market.load_market(spark, _file(tmp_path, text))


def test_options_and_errors():
    assert parse_types("h, br3{2,4}") == {"h": (), "br3": (2, 4)} and len(parse_types("all")) == 20
    assert format_types(parse_types("h,br3{2,4}")) == "h,br3{2,4}"
    assert set_option(Options(), "matrix.symmetric", "true").symmetric
    assert from_environment(env={"WINDOW_SIZE": "64", "NUM_THREADS": "3"}) == Options(window=64, sampling="window", parts=3)
    for name, value in (("no.such", 1), ("matrix.symmetric", "maybe"), ("preproc.sampling.portion", 2)):
        with pytest.raises(errors.OptionError):
            set_option(Options(), name, value)
    seen = []
    errors.set_error_handler(seen.append)
    errors.fail(errors.BoundsError("x"))
    errors.set_error_handler()
    assert [e.code for e in seen] == [4]
    t = errors.Timer()
    t.start(), t.pause()
    assert t.seconds >= 0 and errors.mflops(10, 5, 1e-4) == pytest.approx(1.0)


def test_entry_imports_without_text_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
