"""Approximate nearest neighbours by inner product: a small-world graph per shard.

Vectors are spread over shards of bounded size by a hash of their id. Each shard gets a
hierarchical navigable small-world graph that is held in flat arrays: a row of neighbour
places per vector and level. Queries go to every shard in blocks, and the shards' best are
merged. Largest inner product becomes least distance by one more coordinate,
``sqrt(longest^2 - |v|^2)``, so the graph sees a metric.
"""

from __future__ import annotations

import dataclasses
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import table

SHARD_ROWS, BLOCK_ROWS = 4096, 1024
#: Links on upper levels (twice as many on level 0), breadth of the search when building and asking.
LINKS, BUILD_BREADTH, ASK_BREADTH = 16, 96, 128
BATCH = 256


@dataclasses.dataclass
class Graph:
    """``levels[l]`` is an array (vectors, links) of places, -1 where empty; ``top`` the entry place.

    ``points`` are the distinct vectors, one coordinate longer; ``ids`` of equal vectors lie
    together, in ascending order, from ``first[k]`` to ``first[k + 1]``.
    """

    vectors: np.ndarray
    points: np.ndarray
    levels: list[np.ndarray]
    top: int
    first: np.ndarray
    ids: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, points=self.points, top=self.top, first=self.first, ids=self.ids, **{f"level{k}": x for k, x in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def parse(cls, raw: bytes) -> Graph:
        x = np.load(io.BytesIO(raw))
        levels = [x[f"level{k}"] for k in range(sum(n.startswith("level") for n in x.files))]
        return cls(x["vectors"], x["points"], levels, int(x["top"]), x["first"], x["ids"])


def _search(points: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all rows of ``q`` in step: distances and places, nearest first, -1 where none.

    ``entry`` holds places to start from, a row per query.
    """
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(points) + 1), bool)
    seen[:, -1] = True  # place -1
    width = max(breadth, entry.shape[1])
    best_d, best = np.full((n, width), np.inf, np.float32), np.full((n, width), -1, np.int32)
    done = np.ones((n, width), bool)
    d = ((points[entry] - q[:, None]) ** 2).sum(-1)
    order = np.argsort(d, axis=1)
    k = entry.shape[1]
    best_d[:, :k], best[:, :k], done[:, :k] = np.take_along_axis(d, order, 1), np.take_along_axis(entry, order, 1), False
    seen[rows, entry] = True
    active = np.arange(n)
    while len(active):
        open_d = np.where(done[active], np.inf, best_d[active])
        at = open_d.argmin(axis=1)
        go = np.isfinite(open_d[np.arange(len(active)), at])
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        near = links[best[active, at]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        dn = points[near] - q[active][:, None]
        dn = np.einsum("qkd,qkd->qk", dn, dn)
        dn[~fresh] = np.inf
        all_d = np.concatenate([best_d[active], dn], axis=1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        best_d[active] = np.take_along_axis(all_d, keep, 1)
        best[active] = np.take_along_axis(np.concatenate([best[active], near], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), keep, 1)
    order = np.argsort(best_d, axis=1)
    best_d, best = np.take_along_axis(best_d, order, 1)[:, :breadth], np.take_along_axis(best, order, 1)[:, :breadth]
    best[~np.isfinite(best_d)] = -1
    return best_d, best


def _choose(points: np.ndarray, d: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the candidates (sorted by distance), leaving out one that is nearer to a
    chosen one than to the point itself; left-out ones fill what room remains."""
    n, c = near.shape
    between = points[near]
    sq = (between**2).sum(-1)
    pair = sq[:, :, None] + sq[:, None, :] - 2 * between @ between.transpose(0, 2, 1)
    valid = (near >= 0) & np.isfinite(d)
    chosen = np.zeros((n, c), bool)
    for k in range(c):
        crowded = (chosen & (pair[:, k] < d[:, k, None])).any(axis=1)
        chosen[:, k] = valid[:, k] & ~crowded & (chosen.sum(axis=1) < most)
    rank = np.where(chosen, np.arange(c), np.where(valid, c + np.arange(c), 2 * c))
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(near, order, 1)
    out[np.take_along_axis(~valid, order, 1)] = -1
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds to each neighbour of the places ``new`` a link back, choosing anew where too many."""
    most = links.shape[1]
    to, came = links[new].ravel(), np.repeat(new, most)
    to, came = to[to >= 0], came[to >= 0]
    order = np.argsort(to, kind="stable")
    to, came = to[order], came[order]
    places, start, n = np.unique(to, return_index=True, return_counts=True)
    for group in np.array_split(np.arange(len(places)), max(1, len(places) // BATCH)):
        if not len(group):
            continue
        wide = np.full((len(group), most + n[group].max()), -1, np.int32)
        wide[:, :most] = links[places[group]]
        for row, g in enumerate(group):
            wide[row, most : most + n[g]] = came[start[g] : start[g] + n[g]]
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        wide[wide == places[group][:, None]] = -1
        d = ((points[wide] - points[places[group]][:, None]) ** 2).sum(-1)
        d[wide < 0] = np.inf
        order = np.argsort(d, axis=1)
        links[places[group]] = _choose(points, np.take_along_axis(d, order, 1), np.take_along_axis(wide, order, 1), most)


def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    """Graph over a shard. One vector per id: of rows with equal ids the smallest vector counts.
    Equal vectors are one point."""
    order = np.lexsort((*vectors.T[::-1], ids))
    order = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if len(order) else order
    ids, vectors = ids[order], vectors[order]
    distinct, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.lexsort((ids, which))
    ids, first = ids[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(distinct)))])
    norm = (distinct**2).sum(axis=1)
    points = np.concatenate([distinct, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1).astype(np.float32)
    n = len(points)
    rng = np.random.default_rng(1)
    level_of = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    turn = np.lexsort((rng.permutation(n), -level_of))  # upper levels first: the entry never changes
    levels = [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(int(level_of.max(initial=0)) + 1)]
    top, done = int(turn[0]) if n else -1, 1
    while done < n:
        batch = turn[done : done + min(BATCH, max(1, done // 2))]
        entry = np.full((len(batch), 1), top, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            here = level_of[batch] >= k
            if k and not here.any():
                _, near = _search(points, levels[k], points[batch], entry, 1)
                entry = near[:, :1]
                continue
            d, near = _search(points, levels[k], points[batch], entry, BUILD_BREADTH)
            mine = np.flatnonzero(here)
            peers = batch[mine]
            dp = ((points[peers][:, None] - points[peers][None]) ** 2).sum(-1)  # members of a batch see each other
            np.fill_diagonal(dp, np.inf)
            wide_d = np.concatenate([d[mine], dp], axis=1)
            wide = np.concatenate([near[mine], np.broadcast_to(peers, (len(mine), len(peers)))], axis=1)
            keep = np.argsort(wide_d, axis=1)[:, :BUILD_BREADTH]
            chosen = _choose(points, np.take_along_axis(wide_d, keep, 1), np.take_along_axis(wide, keep, 1), LINKS)
            levels[k][peers] = _padded(chosen, levels[k].shape[1])
            _link_back(points, levels[k], peers)
            entry = near[:, :1]
        done += len(batch)
    return Graph(distinct, points, levels, top, first, ids)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([x, np.full((len(x), width - x.shape[1]), -1, x.dtype)], axis=1)


def ask(graph: Graph, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and inner products in double precision, at most ``k`` a query."""
    out = [], [], []
    if not len(graph.points):
        return tuple(np.array(x, t) for x, t in zip(out, (np.int64, np.int64, float)))
    for lo in range(0, len(queries), BATCH):
        qid, q = query_ids[lo : lo + BATCH], queries[lo : lo + BATCH]
        length = np.sqrt((q**2).sum(axis=1, keepdims=True))
        # only the direction of a query matters; at the points' length rounding is least
        scale = np.sqrt((graph.vectors**2).sum(axis=1).max()) / length
        flat = np.concatenate([q * scale, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        entry = np.full((len(q), 1), graph.top, np.int32)
        for level in graph.levels[:0:-1]:
            entry = _search(graph.points, level, flat, entry, 1)[1]
        near = _search(graph.points, graph.levels[0], flat, entry, max(ASK_BREADTH, 2 * k))[1]
        score = (graph.vectors[near] * q[:, None]).sum(axis=-1)
        score[near < 0] = -np.inf
        for row, (own, places) in enumerate(zip(qid, near)):
            good = np.argsort(-score[row], kind="stable")[: k + 1]
            good = good[places[good] >= 0]
            ids = [graph.ids[graph.first[p] : graph.first[p + 1]][: k + 1] for p in places[good]]
            s = np.repeat(score[row][good], [len(x) for x in ids])
            ids = np.concatenate(ids)
            s, ids = s[ids != own], ids[ids != own]
            best = np.lexsort((ids, -s))[:k]
            out[0].append(np.full(len(best), own)), out[1].append(ids[best]), out[2].append(s[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector that is finite throughout and isn't zero, as doubles."""
    slim = df.select(F.col(id_col).cast("long").alias("g_id"), F.col(vec_col).cast("array<double>").alias("g_vec"))
    v = F.col("g_vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return slim.where(F.col("g_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard, dim, graph``: a row per shard and vector length, written to the shared folder.

    Every usable row is indexed. Rows whose vector is null, empty, zero or not finite
    throughout, or whose id is null, take no part; of rows with one id the smallest vector
    counts. An empty table gives an empty index.
    """
    rows = _usable(df, id_col, vec_col)
    shards = max(1, -(-rows.count() // shard_rows))

    def run(tables):
        g = build(tables.column("g_id").to_numpy(), _matrix(tables.column("g_vec")))
        return pa.table({"shard": tables.column("shard").slice(0, 1), "dim": tables.column("dim").slice(0, 1), "graph": pa.array([g.dump()], pa.binary())})

    placed = rows.select("g_id", "g_vec", F.pmod(F.xxhash64("g_id"), F.lit(shards)).cast("int").alias("shard"), F.size("g_vec").alias("dim"))
    # a partition per shard, so that shards are built side by side whatever their bytes
    return table(placed.repartition(shards, "shard").groupBy("shard", "dim").applyInArrow(run, "shard int, dim int, graph binary"), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found but itself, ties to the smaller id.

    Unusable query rows, as in ``build_index``, give no result; a repeated query id is asked
    once, with its smallest vector. Queries meet only vectors of their own length.
    """
    asked = _usable(queries, id_col, vec_col).groupBy("g_id").agg(F.min("g_vec").alias("g_vec")).withColumn("dim", F.size("g_vec"))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("g_id", F.lit("block")), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("shard").alias("g_shard"), F.col("dim").alias("g_dim"))
    n = max(1, index.count())
    # the query set against all shards in blocks: ids of shards are few, a row for each 4096 vectors
    sent = asked.join(shards, F.col("dim") == F.col("g_dim")).select("g_id", "g_vec", "block", F.col("g_shard").alias("shard"), F.col("g_dim").alias("dim"))
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, graphs, queries_):
        if not graphs.num_rows or not queries_.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        g = Graph.parse(graphs.column("graph")[0].as_py())
        q, v, s = ask(g, queries_.column("g_id").to_numpy(), _matrix(queries_.column("g_vec")), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    tasks = n * blocks
    keys = ["shard", "dim", "block"]
    found = (
        pairs.repartition(tasks, *keys).groupBy(*keys).cogroup(sent.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
