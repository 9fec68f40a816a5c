"""Queries of the sparse-matrix operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import xform
from gridloom.model import Matrix, matrix, spread
from gridloom.operators import access, partition, products, reorder, vectors
from gridloom.options import Options
from gridloom.plans import encode, mining
from gridloom.sources import csr, store

OPTIONS = Options(sampling="none")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part(spark, d) -> Matrix:
    """Orders by parts, with quantities; repeated coordinates stay as they are."""
    n = _read(spark, d, "orders").agg(F.max("o_orderkey") + 1).first()[0]
    m = _read(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    return matrix(_read(spark, d, "lineitem"), n, m, "l_orderkey", "l_partkey", "l_quantity")


def supplier_part(spark, d) -> Matrix:
    n = _read(spark, d, "supplier").agg(F.max("s_suppkey") + 1).first()[0]
    m = _read(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    items = _read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    most = items.count()
    sums = spread(items, most, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    return matrix(sums, n, m, "l_suppkey", "l_partkey", "v", most=most, distinct=True)


def trade(spark, d) -> Matrix:
    """Nations by nations: line items between supplier and customer nation, made symmetric, with a full diagonal."""
    li = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").count()
    so = F.broadcast(_read(spark, d, "supplier").select("s_suppkey", "s_nationkey")) if _read(spark, d, "supplier").count() <= 1_000_000 else _read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey").join(_read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    e = li.join(so, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.groupBy(F.col("s_nationkey").cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("j")).agg(F.sum("count").cast("double").alias("v"))
    diagonal = spark.range(25).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    both = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).unionByName(diagonal)
    return Matrix(both.groupBy("i", "j").agg(F.sum("v").alias("v")), 25, 25, True)


def prices(spark, d) -> DataFrame:
    return _read(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


def suppliers(spark, d) -> DataFrame:
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))


def customers(spark, d) -> DataFrame:
    """Balances of the customers whose numbers are supplier numbers too."""
    n = _read(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]
    return _read(spark, d, "customer").where(F.col("c_custkey") <= n).select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))


def reversal(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("old_i"), (F.lit(n - 1) - F.col("id")).alias("new_i"))


def rounded(v: DataFrame, name: str = "v") -> DataFrame:
    return v.select("i", F.round(name, 4).alias(name))


A = "a AS (SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem)"
S = "s AS (SELECT l_suppkey AS i, l_partkey AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
T = """e AS (SELECT s_nationkey AS i, c_nationkey AS j, CAST(COUNT(*) AS DOUBLE) AS v FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
t AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, SUM(v) AS v FROM (SELECT i, j, v FROM e UNION ALL SELECT j, i, v FROM e UNION ALL SELECT range, range, 1.0 FROM range(25)) GROUP BY 1, 2)"""
U = "u AS (SELECT s_suppkey AS i, s_acctbal AS v FROM supplier), w AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer WHERE c_custkey <= (SELECT MAX(s_suppkey) FROM supplier))"
DIMS = "n AS (SELECT MAX(s_suppkey) + 1 AS n FROM supplier), m AS (SELECT MAX(p_partkey) + 1 AS m FROM part)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# products


@query("spmv_mult", f"WITH {A}, y AS (SELECT i, 0.5 * SUM(v * p_retailprice) AS v FROM a JOIN part ON j = p_partkey GROUP BY i) SELECT o_orderkey AS i, ROUND(COALESCE(v, 0), 4) AS v FROM orders LEFT JOIN y ON i = o_orderkey")
def spmv_mult(spark, d):
    return rounded(products.multiply(0.5, order_part(spark, d), prices(spark, d)))


@query("spmv_kernel", f"WITH {A}, y AS (SELECT i, 0.8 * SUM(v * p_retailprice) AS v FROM a JOIN part ON j = p_partkey GROUP BY i) SELECT o_orderkey AS i, ROUND(COALESCE(v, 0) + 0.42 * o_totalprice, 4) AS v FROM orders LEFT JOIN y ON i = o_orderkey")
def spmv_kernel(spark, d):
    y = _read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    return rounded(products.kernel(0.8, order_part(spark, d), prices(spark, d), 0.42, y))


@query("spmv_kernel_128", f"WITH {A}, y AS (SELECT i, 0.8 * (1 - POWER(0.42, 128)) / 0.58 * SUM(v * p_retailprice) AS v FROM a JOIN part ON j = p_partkey GROUP BY i) SELECT o_orderkey AS i, ROUND(COALESCE(v, 0) + POWER(0.42, 128) * o_totalprice, 3) AS v FROM orders LEFT JOIN y ON i = o_orderkey")
def spmv_kernel_128(spark, d):
    y = _read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    out = products.kernel_repeated(0.8, order_part(spark, d), prices(spark, d), 0.42, y, 128)
    return out.select("i", F.round("v", 3).alias("v"))


@query("spmv_symmetric", f"WITH {T} SELECT i, ROUND(0.5 * SUM(v * (j + 1)), 4) AS v FROM t GROUP BY i")
def spmv_symmetric(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    return rounded(products.multiply(0.5, trade(spark, d), x))


@query("spmv_symmetric_kernel", f"WITH {T} SELECT i, ROUND(0.8 * SUM(v * (j + 1)) + 0.42 * (i + 1), 4) AS v FROM t GROUP BY i")
def spmv_symmetric_kernel(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    return rounded(products.kernel(0.8, trade(spark, d), x, 0.42, x))


@query("spmv_units", f"WITH {S} SELECT s_suppkey AS i, ROUND(COALESCE(y, 0), 4) AS v FROM supplier LEFT JOIN (SELECT i, 0.5 * SUM(v * p_retailprice) AS y FROM s JOIN part ON j = p_partkey GROUP BY i) ON i = s_suppkey")
def spmv_units(spark, d):
    t = encode.tune(supplier_part(spark, d), Options(sampling="none", types="h,br2", parts=2, min_coverage=0.01))
    return rounded(encode.multiply_units(0.5, t, prices(spark, d)))


@query("coo_nnz_dims", f"WITH {A} SELECT COUNT(*) AS nnz, (SELECT MAX(o_orderkey) + 1 FROM orders) AS nrows, (SELECT MAX(p_partkey) + 1 FROM part) AS ncols FROM a")
def coo_nnz_dims(spark, d):
    a = order_part(spark, d)
    return a.df.agg(F.count("*").alias("nnz")).select("nnz", F.lit(a.nrows).cast("long").alias("nrows"), F.lit(a.ncols).cast("long").alias("ncols"))


# vectors


def _vectors(name: str, expr: str, f, extra: str = ""):
    query(name, f"WITH {U} SELECT u.i, ROUND({expr}, 4) AS v FROM u JOIN w ON u.i = w.i{extra}")(lambda spark, d: rounded(f(suppliers(spark, d), customers(spark, d))))


_IN = "CASE WHEN u.i >= 10 AND u.i < 60 THEN {} ELSE {} END"
_vectors("vec_add", "u.v + w.v", vectors.add)
_vectors("vec_sub", "u.v - w.v", vectors.sub)
_vectors("vec_scale", "2.5 * u.v", lambda u, w: vectors.scale(u, 2.5))
_vectors("vec_scale_add", "u.v + 2.5 * w.v", lambda u, w: vectors.scale_add(u, w, 2.5))
_vectors("vec_add_part", _IN.format("u.v + w.v", "u.v"), lambda u, w: vectors.add_part(u, w, u, 10, 60))
_vectors("vec_sub_part", _IN.format("u.v - w.v", "u.v"), lambda u, w: vectors.sub_part(u, w, u, 10, 60))
_vectors("vec_scale_part", _IN.format("2.5 * u.v", "u.v"), lambda u, w: vectors.scale_part(u, 2.5, 10, 60))
_vectors("vec_scale_add_part", _IN.format("u.v + 2.5 * w.v", "w.v"), lambda u, w: vectors.scale_add_part(u, w, w, 2.5, 10, 60))
_vectors("vec_init", "7.25", lambda u, w: vectors.init(u, 7.25))
_vectors("vec_init_part", _IN.format("7.25", "u.v"), lambda u, w: vectors.init_part(u, 7.25, 10, 60))
_vectors("vec_set_entry", "CASE WHEN u.i = 3 THEN 0.42 ELSE u.v END", lambda u, w: vectors.set_entry(u, 3, 0.42, 10))
_vectors("vec_copy", "u.v", lambda u, w: vectors.copy(u))
_vectors("vec_gather", "u.v + w.v", lambda u, w: vectors.gather(u.unionByName(w)))


@query("vec_create", "SELECT s_suppkey AS i, 0.0::DOUBLE AS v FROM supplier")
def vec_create(spark, d):
    return vectors.create(spark, _read(spark, d, "supplier").count())


@query("vec_dot", f"WITH {U} SELECT ROUND(SUM(u.v * w.v), 2) AS dot FROM u JOIN w ON u.i = w.i")
def vec_dot(spark, d):
    return vectors.dot(suppliers(spark, d), customers(spark, d)).select(F.round("dot", 2).alias("dot"))


@query("vec_dot_part", f"WITH {U} SELECT ROUND(SUM(u.v * w.v), 2) AS dot FROM u JOIN w ON u.i = w.i WHERE u.i >= 2 AND u.i < 9")
def vec_dot_part(spark, d):
    return vectors.dot(suppliers(spark, d), customers(spark, d), 2, 9).select(F.round("dot", 2).alias("dot"))


@query("vec_compare", "SELECT 0 AS same, -1 AS changed, -2 AS shorter")
def vec_compare(spark, d):
    u, n = suppliers(spark, d), _read(spark, d, "supplier").count()
    other = vectors.scale(u, 1.01)
    row = (vectors.compare(u, vectors.scale(u, 1.0 + 1e-9), n, n), vectors.compare(u, other, n, n), vectors.compare(u, u, n, n - 1))
    return spark.createDataFrame([row], "same int, changed int, shorter int")


@query("vec_random_range", "SELECT TRUE AS inside, COUNT(*) AS n FROM supplier")
def vec_random_range(spark, d):
    v = vectors.random(spark, _read(spark, d, "supplier").count(), seed=3)
    return v.agg(F.min((F.col("v") >= -0.1) & (F.col("v") < 0.1)).alias("inside"), F.count("*").alias("n"))


_REORDERED = "WITH u AS (SELECT (SELECT MAX(s_suppkey) FROM supplier) - s_suppkey AS i, s_acctbal AS v FROM supplier) SELECT i, ROUND(v, 4) AS v FROM u"


@query("vec_reorder", _REORDERED)
def vec_reorder(spark, d):
    u = suppliers(spark, d)
    return rounded(vectors.reorder(u, reversal(spark, u.count())))


@query("vec_inv_reorder", _REORDERED)
def vec_inv_reorder(spark, d):
    u = suppliers(spark, d)
    return rounded(vectors.inverse_reorder(u, reversal(spark, u.count())))


# rows, parts, windows


@query("csr_rowptr", f"WITH {A}, c AS (SELECT i, COUNT(*) AS n FROM a GROUP BY i), r AS (SELECT o_orderkey AS i, COALESCE(n, 0) AS n FROM orders LEFT JOIN c ON i = o_orderkey) SELECT i, n, CAST(SUM(n) OVER (ORDER BY i) AS BIGINT) AS stop FROM r")
def csr_rowptr(spark, d):
    return csr.row_pointers(order_part(spark, d))


@query("csr_entries", f"WITH {S} SELECT ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS pos, j, v FROM s")
def csr_entries(spark, d):
    return csr.to_csr(supplier_part(spark, d))[1]


@query("csr_roundtrip", f"WITH {T} SELECT i, j, v FROM t")
def csr_roundtrip(spark, d):
    a = trade(spark, d)
    ptr, entries = csr.to_csr(a)  # 25 rows
    p = [0] + [r.stop for r in ptr.orderBy("i").collect()]
    e = entries.orderBy("pos").collect()
    return csr.load_csr(spark, p, [r.j for r in e], [r.v for r in e], 25, 25).df


_CUT = f"WITH {S}, c AS (SELECT s_suppkey AS i, COUNT(v) AS n FROM supplier LEFT JOIN s ON i = s_suppkey GROUP BY 1), r AS (SELECT i, SUM(n) OVER (ORDER BY i) AS stop, SUM(n) OVER () AS nnz FROM c), k AS (SELECT MIN(i) + 1 AS cut, MIN(stop) AS stop, MIN(nnz) AS nnz FROM r WHERE stop >= nnz // 2) SELECT 0 AS part, 0::BIGINT AS row_start, cut AS row_end, CAST(stop AS BIGINT) AS nnz FROM k UNION ALL SELECT 1, cut, (SELECT MAX(s_suppkey) + 1 FROM supplier), CAST(nnz - stop AS BIGINT) FROM k"


@query("part_balanced", _CUT)
def part_balanced(spark, d):
    return partition.balanced(supplier_part(spark, d), 2)


@query("part_fixed", _CUT)
def part_fixed(spark, d):
    return partition.fixed(supplier_part(spark, d), 2)


@query("part_rows_nnz", f"WITH {S} SELECT CASE WHEN i < 10 THEN 0 ELSE 1 END AS part, COUNT(*) AS nnz FROM s GROUP BY 1")
def part_rows_nnz(spark, d):
    a = supplier_part(spark, d)
    parts = spark.createDataFrame([(0, 0, 10), (1, 10, a.nrows)], "part int, row_start long, row_end long")
    return partition.with_parts(a, parts).groupBy("part").agg(F.count("*").alias("nnz"))


@query("symmetric_split", f"WITH {T} SELECT i >= 10 AND j < 10 AS remote, COUNT(*) AS n, SUM(v) AS v FROM t WHERE i > j GROUP BY 1")
def symmetric_split(spark, d):
    parts = spark.createDataFrame([(0, 0, 10), (1, 10, 25)], "part int, row_start long, row_end long")
    return partition.symmetric_split(trade(spark, d), parts)[0].groupBy("remote").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("row_window", f"WITH {S} SELECT i - 5 AS i, j, v FROM s WHERE i >= 5 AND i < 9")
def row_window(spark, d):
    return xform.row_window(supplier_part(spark, d).df, 5, 9)


@query("sample_windows", f"WITH {S}, c AS (SELECT s_suppkey AS i, COUNT(v) AS n FROM supplier LEFT JOIN s ON i = s_suppkey GROUP BY 1), r AS (SELECT i, n, SUM(n) OVER (ORDER BY i) - n AS before FROM c) SELECT CAST(before // 500 AS BIGINT) AS w, MIN(i) AS start, MAX(i) + 1 AS \"end\", CAST(SUM(n) AS BIGINT) AS nnz FROM r GROUP BY 1")
def sample_windows(spark, d):
    return mining.row_windows(supplier_part(spark, d), 500)


@query("stats_sampled")
def stats_sampled(spark, d):
    return mining.sampled_stats(supplier_part(spark, d), Options(samples=8, portion=0.2), ["h", "d"])


# orders of iteration

_FORWARD = {
    "h": ("i + 1", "j + 1"),
    "v": ("j + 1", "i + 1"),
    "d": ("n + j - i", "LEAST(i, j) + 1"),
    "ad": ("i + j + 1", "CASE WHEN i + j + 1 <= m THEN i + 1 ELSE m - j END"),
    **{f"br{r}": (f"i // {r} + 1", f"i % {r} + {r} * j + 1") for r in range(1, 9)},
    **{f"bc{r}": (f"j // {r} + 1", f"j % {r} + {r} * i + 1") for r in range(1, 9)},
}


def _forward_sql(kind: str) -> str:
    a, b = _FORWARD[kind]
    return f"t AS (SELECT i, j, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b FROM s, n, m)"


for _kind in ("h", "v", "d", "ad", "br3", "bc4"):

    def _x(spark, d, kind=_kind):
        a = supplier_part(spark, d)
        return xform.transformed(a.df.drop("v"), kind, a.nrows, a.ncols)

    query(f"xform_{_kind}", f"WITH {S}, {DIMS}, {_forward_sql(_kind)} SELECT i, j, a, b FROM t")(_x)


@query("xform_roundtrip", f"WITH {S} SELECT i, j, k AS kind FROM s, (SELECT UNNEST(['v', 'd', 'ad', 'br3', 'bc4']) AS k)")
def xform_roundtrip(spark, d):
    a, out = supplier_part(spark, d), None
    for kind in ("v", "d", "ad", "br3", "bc4"):
        t = xform.transformed(a.df.drop("v"), kind, a.nrows, a.ncols)
        p, q = xform.between(kind, "bc2", F.col("a"), F.col("b"), a.nrows, a.ncols)
        r, c = xform.inverse("bc2", F.col("p"), F.col("q"), a.nrows, a.ncols)
        one = t.select(p.alias("p"), q.alias("q")).select((r - 1).cast("long").alias("i"), (c - 1).cast("long").alias("j"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


# mining

_E4 = """d AS (SELECT a, b, b - COALESCE(LAG(b) OVER (PARTITION BY a ORDER BY b), 0) AS k FROM t),
g AS (SELECT a, b, k, LAG(k) OVER (PARTITION BY a ORDER BY b) AS pk FROM d),
c AS (SELECT a, k, SUM(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY a ORDER BY b) AS q FROM g),
r AS (SELECT a, q, MIN(k) AS k, COUNT(*) AS f FROM c GROUP BY a, q)"""
_E4B = (
    _E4
    + """,
z AS (SELECT a, q, k, f, MAX(CASE WHEN q > 1 AND f > 1 AND f = 3 THEN NULL
  ELSE q * 2 + (CASE WHEN f >= 4 THEN 1 ELSE 0 END + q) % 2 END) OVER (PARTITION BY a ORDER BY q) AS z FROM r),
p AS (SELECT a, q, k, f, (z % 2 + q) % 2 AS acc FROM z),
x AS (SELECT a, q, k, acc, f + CASE WHEN q > 1 AND LAG(acc) OVER (PARTITION BY a ORDER BY q) = 0 THEN 1 ELSE 0 END AS rn FROM p),
st AS (SELECT '{kind}' AS type, CAST(k AS BIGINT) AS inst, CAST(SUM(rn - CASE WHEN rn % 255 < 4 THEN rn % 255 ELSE 0 END) AS BIGINT) AS nnz,
  CAST(SUM((rn - rn % 255) / 255 + CASE WHEN rn % 255 >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS pat FROM x WHERE acc = 1 GROUP BY k)"""
)
_E5 = """y AS (SELECT a, b, b - ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) AS isl FROM t),
l AS (SELECT a, isl, COUNT(*) AS len, ({r} - (MIN(b) - 1) % {r}) % {r} AS skip FROM y GROUP BY a, isl),
o AS (SELECT (len - skip) // {r} AS od FROM l WHERE len > skip),
st AS (SELECT '{kind}' AS type, CAST(od AS BIGINT) AS inst, CAST(SUM(od * {r}) AS BIGINT) AS nnz, COUNT(*) AS pat FROM o WHERE od >= 2 GROUP BY od)"""


def _stats_sql(kind: str) -> str:
    body = _E4B.replace("{kind}", kind) if kind in ("h", "v", "d", "ad") else _E5.format(r=kind[2:], kind=kind)
    return f"WITH {S}, {DIMS}, {_forward_sql(kind)}, {body} "


for _kind in ("h", "v", "d", "ad", *[f"br{k}" for k in range(2, 9)], *[f"bc{k}" for k in range(2, 9)]):

    def _s(spark, d, kind=_kind):
        a = supplier_part(spark, d)
        return mining.type_stats(mining.coordinates(a), kind, a.nrows, a.ncols, OPTIONS, a.most)

    query(f"stats_{_kind}", _stats_sql(_kind) + "SELECT type, inst, nnz, pat FROM st")(_s)


def _h_stats(spark, d):
    a = supplier_part(spark, d)
    return a, mining.type_stats(mining.coordinates(a), "h", a.nrows, a.ncols, OPTIONS, a.most)


@query("delta_encode", f"WITH {S}, {DIMS}, {_forward_sql('h')}, {_E4} SELECT a, b, k FROM d")
def delta_encode(spark, d):
    a = supplier_part(spark, d)
    return mining.delta_encode(mining.ordered(mining.coordinates(a), "h", a.nrows, a.ncols, a.most))


@query("max_delta", f"WITH {S}, {DIMS}, {_forward_sql('h')} SELECT MAX(k) AS max_delta FROM (SELECT b - LAG(b) OVER (PARTITION BY a ORDER BY b) AS k FROM t)")
def max_delta(spark, d):
    a = supplier_part(spark, d)
    return mining.max_delta(mining.ordered(mining.coordinates(a), "h", a.nrows, a.ncols, a.most))


@query("rle_runs", f"WITH {S}, {DIMS}, {_forward_sql('h')}, {_E4} SELECT a, CAST(q AS BIGINT) AS q, k, f FROM r")
def rle_runs(spark, d):
    a = supplier_part(spark, d)
    return mining.runs(mining.ordered(mining.coordinates(a), "h", a.nrows, a.ncols, a.most))


@query("coverage_filter", _stats_sql("h") + "SELECT type, inst, nnz, pat FROM st WHERE nnz >= 0.001 * (SELECT COUNT(*) FROM s)")
def coverage_filter(spark, d):
    a, s = _h_stats(spark, d)
    return mining.covered(s, a.nnz, 0.001)


@query("stats_scaled", _stats_sql("h") + "SELECT type, inst, CAST(FLOOR(nnz * 2.5::DOUBLE) AS BIGINT) AS nnz, CAST(FLOOR(pat * 2.5::DOUBLE) AS BIGINT) AS pat FROM st")
def stats_scaled(spark, d):
    return mining.scaled(_h_stats(spark, d)[1], 2.5)


@query("stats_merge", _stats_sql("h") + "SELECT type, inst, 2 * nnz AS nnz, 2 * pat AS pat FROM st")
def stats_merge(spark, d):
    s = _h_stats(spark, d)[1]
    return mining.merge(s, s)


@query("stats_rollup", _stats_sql("h") + "SELECT type, inst, CAST(SUM(nnz) AS BIGINT) AS nnz, CAST(SUM(pat) AS BIGINT) AS pat, CASE GROUPING(type, inst) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level FROM st GROUP BY ROLLUP (type, inst)")
def stats_rollup(spark, d):
    return mining.rollup(_h_stats(spark, d)[1])


@query("type_scores", _stats_sql("h") + "SELECT type, CAST(SUM(nnz) - SUM(pat) AS BIGINT) AS score FROM st GROUP BY type")
def type_scores(spark, d):
    return mining.score(_h_stats(spark, d)[1])


@query("type_scores_cost", _stats_sql("h") + "SELECT type, CAST(GREATEST(0, SUM(nnz) - 2 * SUM(pat)) AS BIGINT) AS score FROM st GROUP BY type")
def type_scores_cost(spark, d):
    return mining.score(_h_stats(spark, d)[1], "cost")


@query("choose_type", _stats_sql("h") + "SELECT type, CAST(SUM(nnz) - SUM(pat) AS BIGINT) AS score FROM st GROUP BY type HAVING SUM(nnz) > SUM(pat)")
def choose_type(spark, d):
    return mining.choose(mining.score(_h_stats(spark, d)[1]))


_GAPS = f"WITH {S}, g AS (SELECT i, j - COALESCE(LAG(j) OVER (PARTITION BY i ORDER BY j), 0) AS k FROM s), b AS (SELECT i, k, CASE WHEN k < 256 THEN 1 WHEN k < 65536 THEN 2 WHEN k < 4294967296 THEN 4 ELSE 8 END AS bytes FROM g) "


@query("delta_byte_classes", _GAPS + "SELECT bytes, COUNT(*) AS n FROM b GROUP BY 1")
def delta_byte_classes(spark, d):
    a = supplier_part(spark, d)
    gaps = mining.delta_encode(spread(mining.coordinates(a), a.most, "i").toDF("a", "b"))
    return gaps.groupBy(mining.delta_bytes(F.col("k")).alias("bytes")).agg(F.count("*").alias("n"))


@query("delta_unit_stats", _GAPS + ", r AS (SELECT i, COUNT(*) AS n, MAX(bytes) AS bytes FROM b GROUP BY i) SELECT CAST(SUM(CEIL(n / 255)) AS BIGINT) AS units, CAST(SUM(FLOOR(GREATEST(0, 4 - bytes) * n / 4)) AS BIGINT) AS saved FROM r")
def delta_unit_stats(spark, d):
    a = supplier_part(spark, d)
    return mining.delta_unit_stats(mining.coordinates(a), OPTIONS, most=a.most)


# units


def _tuned(spark, d, **more):
    return encode.tune(supplier_part(spark, d), Options(**({"sampling": "none", "types": "h,v", "min_coverage": 0.001} | more)))


@query("decode_roundtrip", f"WITH {S} SELECT i, j, v FROM s")
def decode_roundtrip(spark, d):
    return encode.decode(_tuned(spark, d).units)


@query("decode_explicit_blocks", f"WITH {S} SELECT i, j, v FROM s")
def decode_explicit_blocks(spark, d):
    return encode.decode(_tuned(spark, d, types="br2{2,3},bc2{2},d{1},ad{1}").units)


@query("pattern_report")
def pattern_report(spark, d):
    return encode.pattern_ids(_tuned(spark, d).units)


@query("compressed_size")
def compressed_size(spark, d):
    return encode.compressed_size(_tuned(spark, d))


@query("row_span")
def row_span(spark, d):
    return encode.row_span(_tuned(spark, d).units)


@query("row_info", f"WITH {S}, c AS (SELECT s_suppkey AS row, COUNT(v) AS n FROM supplier LEFT JOIN s ON i = s_suppkey GROUP BY 1) SELECT row, CAST(SUM(n) OVER (ORDER BY row) - n AS BIGINT) AS first FROM c")
def row_info(spark, d):
    return encode.row_info(_tuned(spark, d, types="h"))


@query("save_restore", f"WITH {S} SELECT i, j, v FROM s")
def save_restore(spark, d):
    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = f"{base.get() if base.isDefined() else tempfile.mkdtemp()}/units-{uuid.uuid4().hex}"
    store.save(_tuned(spark, d, types="h"), path)
    return encode.decode(store.restore(spark, path).units)


@query("get_entry", f"WITH {S} SELECT v FROM s WHERE i = 7 ORDER BY j LIMIT 1")
def get_entry(spark, d):
    a = supplier_part(spark, d)
    j = a.df.where("i = 7").agg(F.min("j")).first()[0]
    return spark.createDataFrame([(access.get_entry(_tuned(spark, d), 7, j),)], "v double")


@query("set_entry", f"WITH {S} SELECT i, j, CASE WHEN i = 7 AND j = (SELECT MIN(j) FROM s WHERE i = 7) THEN 0.42 ELSE v END AS v FROM s WHERE i = 7")
def set_entry(spark, d):
    a = supplier_part(spark, d)
    j = a.df.where("i = 7").agg(F.min("j")).first()[0]
    return encode.decode(access.set_entry(_tuned(spark, d), 7, j, 0.42).units).where("i = 7")


# reordering


@query("bandwidth", f"WITH {T} SELECT MAX(ABS(i - j)) AS bandwidth FROM t")
def bandwidth(spark, d):
    return reorder.bandwidth(trade(spark, d))


@query("perm_apply", f"WITH {T} SELECT 24 - i AS i, 24 - j AS j, v FROM t")
def perm_apply(spark, d):
    return reorder.permuted(trade(spark, d), reversal(spark, 25)).df


@query("rcm_invariance", f"WITH {T} SELECT i, ROUND(SUM(v * (j + 1)), 4) AS v FROM t GROUP BY i")
def rcm_invariance(spark, d):
    a = trade(spark, d)
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    perm = reorder.rcm(a)
    y = products.multiply(1.0, reorder.permuted(a, perm), vectors.reorder(x, perm))
    return rounded(vectors.inverse_reorder(y, perm))
