"""Content-addressed store of token ids.

Rolling hashes over the id stream of each document choose the ends of chunks, so equal
passages give equal chunks. A chunk is stored once under the hash of its ids. A document is a
recipe: the list of its chunks. Recipes lie in ascending ``doc_id`` order with the number of
ids before each, and a Merkle manifest covers recipes and chunks.

Layout under the store's path, all of it Parquet::

    objects/   kind=1: key, n, payload                 a row per distinct chunk
               kind=0: the recipes before they are put in order
    recipes/   pid, pos, doc_id, start, n_tokens, recipe a row per document, ascending
    manifest/  kind, pid, rows, ids, root              a Merkle root per part

``recipe`` holds 20 bytes a chunk: 16 of key and 4 of length. A payload is zstd over ids of
2 or 4 bytes, named by its first byte.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import drop_path, held, lean, scratch
from gridloom.llm.tokenizing import WordEncoder

WINDOW = 16
SHORTEST, USUAL, LONGEST = 256, 1024, 8192
_RANDOM = np.random.default_rng(20).integers(0, 2**64, 65536, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of chunks: where the hash of the last ``WINDOW`` ids is 0 in ``log2(USUAL)`` bits."""
    n = len(ids)
    if n <= SHORTEST:
        return [n]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[ids & 0xFFFF], dtype=np.uint64)])
    rolling = (run[WINDOW:] - run[:-WINDOW]) * _MIX
    marks = np.flatnonzero(rolling >> np.uint64(64 - USUAL.bit_length() + 1) == 0) + WINDOW
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if m - last >= SHORTEST and m < n:
            ends.append(m)
            last = m
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return [*ends, n]


def key_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def pack(ids: np.ndarray, squeeze) -> bytes:
    narrow = ids.max(initial=0) < 65536
    return (b"\x02" if narrow else b"\x04") + squeeze.compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(payload: bytes, expand) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(expand.decompress(payload[1:]), "<u2" if payload[0] == 2 else "<u4").astype("<u4").tobytes()


def merkle(leaves) -> bytes:
    """Root over leaves in order, with a stack of one node a level; no leaf: the hash of nothing."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        level, node = 0, key_of(b"\0" + leaf)
        while stack and stack[-1][0] == level:
            node = key_of(b"\1" + stack.pop()[1] + node)
            level += 1
        stack.append((level, node))
    if not stack:
        return key_of(b"")
    node = stack.pop()[1]
    while stack:
        node = key_of(b"\1" + stack.pop()[1] + node)
    return node


def _encode(path: str, end_id: int, id_type: pa.DataType):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder = _encoder(path)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                rows, seen = [], set()
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = encoder.encode(text) + end
                    ids = np.frombuffer(raw, "<u4")
                    recipe, at = [], 0
                    for stop in chunk_ends(ids):
                        key = key_of(raw[4 * at : 4 * stop])
                        recipe.append(key + (stop - at).to_bytes(4, "little"))
                        if key not in seen:
                            seen.add(key)
                            rows.append((1, None, key, stop - at, pack(ids[at:stop], squeeze)))
                        at = stop
                    rows.append((0, doc_id, b"".join(recipe), len(ids), None))
                kinds, doc_ids, keys, ns, payloads = zip(*rows) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(doc_ids, id_type), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(payloads, pa.binary())],
                    names=["kind", "doc_id", "key", "n", "payload"],
                )

    return run


def _encoder(path: str) -> WordEncoder:
    return held(("word encoder", path), lambda: WordEncoder(path))


def _roots(kind: int, leaf: str, count: str):
    def run(batches):
        state = {"rows": 0, "ids": 0, "pid": None}

        def leaves():
            for b in batches:
                for pid, x, n in zip(b.column("pid").to_pylist(), b.column(leaf).to_pylist(), b.column(count).to_pylist()):
                    state["pid"] = pid
                    state["rows"] += 1
                    state["ids"] += n
                    yield x

        root = merkle(leaves())
        if state["rows"]:
            yield pa.RecordBatch.from_pylist([{"kind": kind, "pid": state["pid"], "rows": state["rows"], "ids": state["ids"], "root": root}], _MANIFEST)

    return run


_MANIFEST = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("rows", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())])
_MANIFEST_DDL = "kind int, pid int, rows long, ids long, root binary"


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, parts: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write a store at ``path``.

    Null texts are empty: one id, the end. Rows with equal ids and texts are kept as often as
    they come; rows of one ``doc_id`` with different texts lie in the order of their recipes;
    null ids come first. An empty table gives an empty store. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = slim.mapInArrow(lean(_encode(tokenizer_path, end_id, pa.int64())), "kind int, doc_id long, key binary, n long, payload binary")
    # chunks meet by key and recipes by themselves in one shuffle; each distinct one stays once
    objects = f"{path}/objects"
    (
        rows.repartition(parts, "kind", "doc_id", "key")
        .groupBy("kind", "doc_id", "key")
        .agg(F.first("n").alias("n"), F.first("payload").alias("payload"), F.count("*").alias("copies"))
        .withColumn("pid", F.spark_partition_id())
        .write.partitionBy("kind")
        .option("compression", "zstd")
        .parquet(objects)
    )
    schema = "doc_id long, key binary, n long, payload binary, copies long, pid int"
    kept = spark.read.schema(schema + ", kind int").parquet(objects)
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("recipe"), F.col("copy")]
    recipes = kept.where("kind = 0").select(
        "doc_id", "n", F.col("key").alias("recipe"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    ranged = f"{path}/ranged"
    recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).write.option("compression", "zstd").parquet(ranged)
    ranged_df = spark.read.schema("doc_id long, n long, recipe binary, copy int, pid int").parquet(ranged)
    starts, seen = [], 0
    for pid, n in sorted((r[0], r[1]) for r in ranged_df.groupBy("pid").agg(F.sum("n")).collect()):  # a row for each part
        starts.append((pid, seen))
        seen += n
    before = W.partitionBy("pid").orderBy(*order)
    offsets = spark.createDataFrame(starts, "pid int, offset long")
    placed = (
        ranged_df.withColumn("pos", F.row_number().over(before))
        .withColumn("run", F.sum("n").over(before.rowsBetween(W.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "pid")
        .select("pid", "pos", "doc_id", (F.col("offset") + F.col("run") - F.col("n")).alias("start"), F.col("n").alias("n_tokens"), "recipe")
    )
    placed.repartitionByRange(parts, "pid").sortWithinPartitions("pid", "pos").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _sealed(spark, path).write.parquet(f"{path}/manifest")
    drop_path(spark, ranged)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, n long, payload binary, pid int").parquet(f"{path}/objects/kind=1") if _has(spark, f"{path}/objects/kind=1") else spark.createDataFrame([], "key binary, n long, payload binary, pid int")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pid int, pos int, doc_id long, start long, n_tokens long, recipe binary").parquet(f"{path}/recipes")


def _has(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _sealed(spark: SparkSession, path: str) -> DataFrame:
    """Merkle roots as the files give them now: over the recipes and over the chunks' keys, by part."""

    def by_part(df, leaf, count, kind, order):
        one = df.repartition("pid").sortWithinPartitions("pid", *order)

        def run(batches):
            held, current = [], None
            for b in batches:
                pids = b.column("pid").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), len(pids)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi == lo:
                        continue
                    if current is not None and pids[lo] != current:
                        yield from _roots(kind, leaf, count)(held)
                        held = []
                    current = pids[lo]
                    held.append(b.slice(lo, hi - lo))
            yield from _roots(kind, leaf, count)(held)

        return one.mapInArrow(run, _MANIFEST_DDL)

    leaves = _recipes(spark, path).select("pid", "pos", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"\0"), "recipe"), 256).cast("binary").alias("leaf"), "n_tokens")
    keys = _chunks(spark, path).select("pid", "key", "n")
    return by_part(leaves, "leaf", "n_tokens", 0, ["pos"]).unionByName(by_part(keys, "key", "n", 1, ["key"]))


def verify(spark: SparkSession, path: str) -> bool:
    """Whether recipes and chunk keys still match the manifest and every payload its key."""
    now, then = _sealed(spark, path), spark.read.schema(_MANIFEST_DDL).parquet(f"{path}/manifest")
    same = now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()
    return same and _digests(spark, path).where("NOT whole").isEmpty()


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """key, n, crc of each stored chunk, and whether its ids have that key; payloads stay where they are."""

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            keys, crcs, ns, whole = b.column("key").to_pylist(), [], [], []
            for key, payload in zip(keys, b.column("payload").to_pylist()):
                raw = unpack(payload, expand)
                crcs.append(zlib.crc32(raw))
                ns.append(len(raw) // 4)
                whole.append(key_of(raw) == key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64()), pa.array(whole, pa.bool_())], names=["key", "n", "crc", "whole"])

    return _chunks(spark, path).select("key", "payload").mapInArrow(run, "key binary, n long, crc long, whole boolean")


def _shift_tables() -> np.ndarray:
    """tables[k, j, x]: what byte j with value x of a checksum becomes when 2**k zero bytes follow."""
    byte = np.array([zlib.crc32(bytes([x])) ^ zlib.crc32(b"\0") for x in range(256)], np.uint64)
    one = np.zeros((4, 256), np.uint64)
    x = np.arange(256, dtype=np.uint64)
    for j in range(4):
        v = x << np.uint64(8 * j)
        one[j] = (v >> np.uint64(8)) ^ byte[(v & np.uint64(255)).astype(int)]
    tables = [one]
    for _ in range(44):
        tables.append(_shift(_shift_parts(), tables[-1], tables[-1]))
    return np.stack(tables)


def _shift_parts() -> np.ndarray:
    return np.stack([np.arange(256, dtype=np.uint64) << np.uint64(8 * j) for j in range(4)])


def _shift(_, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for j in range(4):
        out ^= table[j][((values >> np.uint64(8 * j)) & np.uint64(255)).astype(int)]
    return out


_TABLES: list[np.ndarray] = []


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds, by exclusive or, to that of a string in which ``zeros`` bytes follow."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    out = crc.astype(np.uint64)
    for k in range(45):
        on = (zeros >> k) & 1 == 1
        if on.any():
            out[on] = _shift(None, _TABLES[0][k], out[on])
    return out


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the store's files.

    Chunks are read and checked where they lie; their checksums are joined to the recipes and
    combined, so no payload is shuffled. A damaged or missing chunk raises.
    """

    def entries(batches):
        for b in batches:
            pid, pos, key, n, after = [], [], [], [], []
            for p, q, recipe in zip(b.column("pid").to_pylist(), b.column("pos").to_pylist(), b.column("recipe").to_pylist()):
                size = [int.from_bytes(recipe[k + 16 : k + 20], "little") for k in range(0, len(recipe), 20)]
                left = sum(size)
                for k, s in enumerate(size):
                    left -= s
                    pid.append(p), pos.append(q), key.append(recipe[20 * k : 20 * k + 16]), n.append(s), after.append(4 * left)
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(pos, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(after, pa.int64())], names=["pid", "pos", "key", "n", "after"])

    def combine(batches):
        for b in batches:
            part = shifted(b.column("crc").to_numpy(), b.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("pos"), pa.array(part.astype(np.int64))], names=["pid", "pos", "part"])

    recipes = _recipes(spark, path)
    used = recipes.select("pid", "pos", "recipe").mapInArrow(entries, "pid int, pos int, key binary, n long, after long")
    held = _digests(spark, path).select("key", F.col("n").alias("held_n"), "crc", "whole")
    sound = F.coalesce(F.col("whole") & (F.col("held_n") == F.col("n")), F.lit(False))
    checked = used.join(held, "key", "left").select("pid", "pos", "after", F.when(sound, F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is damaged or missing")).cast("long")).alias("crc"))
    sums = checked.mapInArrow(combine, "pid int, pos int, part long").groupBy("pid", "pos").agg(F.bit_xor("part").alias("ids_crc32"))
    return recipes.drop("recipe").join(sums, ["pid", "pos"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` with the ids themselves, put together from chunks."""

    def entries(batches):
        for b in batches:
            for p, q, recipe in zip(b.column("pid").to_pylist(), b.column("pos").to_pylist(), b.column("recipe").to_pylist()):
                yield pa.RecordBatch.from_pylist([{"pid": p, "pos": q, "seq": k, "key": recipe[20 * k : 20 * k + 16]} for k in range(len(recipe) // 20)], pa.schema([("pid", pa.int32()), ("pos", pa.int32()), ("seq", pa.int32()), ("key", pa.binary())]))

    def expanded(batches):
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            raw = [np.frombuffer(unpack(p, expand), "<u4").astype(np.int64) for p in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("pid", "pos", "seq")] + [pa.array(raw, pa.list_(pa.int64()))], names=["pid", "pos", "seq", "ids"])

    recipes = _recipes(spark, path)
    used = recipes.select("pid", "pos", "recipe").mapInArrow(entries, "pid int, pos int, seq int, key binary")
    parts = used.join(_chunks(spark, path).select("key", "payload"), "key").select("pid", "pos", "seq", "payload").mapInArrow(expanded, "pid int, pos int, seq int, ids array<long>")
    whole = parts.groupBy("pid", "pos").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"))
    return recipes.join(whole, ["pid", "pos"]).select("doc_id", "start", "ids")


def store_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write a store (in the shared folder if no path is given) and return ``document_digests`` of it."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-store")
    write_store(docs, tokenizer_path, path, end_id)
    return document_digests(spark, path)
