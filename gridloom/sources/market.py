"""Matrix Market coordinate files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.errors import FormatError, fail
from gridloom.model import Matrix


def _head(spark: SparkSession, path: str):
    banner, comments, size = None, 0, None
    for k, line in enumerate(r.value for r in spark.read.text(path).limit(10_000).toLocalIterator()):
        if k == 0 and line.lower().startswith("%%matrixmarket"):
            banner = line.lower().split()
        elif line.lstrip().startswith("%") or not line.strip():
            continue
        else:
            size = line.split()
            break
    if size is None or len(size) != 3 or not all(x.isdigit() for x in size):
        fail(FormatError("no size line of three numbers"))
    form = {"symmetric": False, "base": 1, "order": "row" if banner is None else "column"}
    if banner is not None:
        if len(banner) < 5 or banner[1:3] != ["matrix", "coordinate"]:
            fail(FormatError("only coordinate matrices are read"))
        if banner[3] not in ("real", "double", "integer"):
            fail(FormatError(f"field {banner[3]!r} isn't read"))
        if banner[4] not in ("general", "symmetric"):
            fail(FormatError(f"symmetry {banner[4]!r} isn't read"))
        form["symmetric"] = banner[4] == "symmetric"
        for word in banner[5:]:
            if word in ("0-base", "1-base"):
                form["base"] = int(word[0])
            elif word in ("row", "column"):
                form["order"] = word
            else:
                fail(FormatError(f"unknown word {word!r}"))
    return form, tuple(int(x) for x in size), " ".join(size)


def read_size(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and stored entries from the size line."""
    return _head(spark, path)[1]


def load_market(spark: SparkSession, path: str) -> Matrix:
    """Read a file, with or without banner.

    Without one the entries are general, 1-based and must be sorted by row; with one the words
    ``0-base``, ``1-base``, ``row`` and ``column`` may follow, and ``row`` asks for sorted rows
    too. Symmetric files are expanded. White space of any kind parts tokens; the last line needs
    no newline. Wrong arity, bad numbers, too few or too many entries raise ``FormatError``.
    """
    form, (nrows, ncols, nnz), _ = _head(spark, path)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t"))
    body = lines.where(~F.get("t", F.lit(0)).startswith("%") & (F.get("t", F.lit(0)) != ""))
    first = body.agg(F.min("line")).first()[0]
    body = body.where(F.col("line") > first)
    shift = form["base"]
    cells = [F.expr(f"try_cast(get(t, {k}) AS {kind})") for k, kind in enumerate(("bigint", "bigint", "double"))]
    parsed = body.select("line", F.size("t").alias("n"), (cells[0] - shift).alias("i"), (cells[1] - shift).alias("j"), cells[2].alias("v"))
    wrong = (F.col("n") != 3) | F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull()
    outside = (F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= nrows) | (F.col("j") >= ncols)
    n, bad, out = parsed.agg(F.count("*"), F.count(F.when(wrong, 1)), F.count(F.when(outside, 1))).first()
    if bad:
        fail(FormatError(f"{bad} lines aren't row, column, value"))
    if out:
        fail(FormatError(f"{out} entries lie outside the matrix"))
    if n != nnz:
        fail(FormatError(f"{n} entries instead of {nnz}"))
    if form["order"] == "row" and not _sorted(parsed):
        fail(FormatError("entries aren't sorted"))
    df = parsed.select("i", "j", "v")
    if form["symmetric"]:
        df = df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return Matrix(df, nrows, ncols, form["symmetric"])


def _sorted(parsed) -> bool:
    """Whether rows and columns ascend with the lines: each file part within itself, then part by part."""
    from pyspark.sql import Window as W

    part = parsed.select(F.shiftright("line", 33).alias("part"), "line", F.struct("i", "j").alias("at"))
    before = F.lag("at").over(W.partitionBy("part").orderBy("line"))
    if not part.withColumn("b", before).where("b > at").isEmpty():
        return False
    ends = part.groupBy("part").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return ends.withColumn("b", F.lag("hi").over(W.orderBy("part"))).where("b > lo").isEmpty()


def save_market(a: Matrix, path: str) -> None:
    """Write a folder of text parts that ``load_market`` reads: banner and size, then 1-based entries sorted by row."""
    spark = a.df.sparkSession
    head = spark.createDataFrame([(-2, -1, "%%MatrixMarket matrix coordinate real general 1-base column"), (-1, -1, f"{a.nrows} {a.ncols} {a.nnz}")], "i long, j long, value string")
    body = a.df.select("i", "j", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange("i").sortWithinPartitions("i", "j").select("value").write.text(path)
