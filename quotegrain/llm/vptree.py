"""Nearest neighbours by largest inner product, with vantage-point trees, one per shard.

Vectors are first dealt to cells: that of the nearest of at most ``CELLS`` pivots, which are vectors themselves. A cell's
vectors are dealt out to shards of about ``SHARD`` vectors; each shard's tree is built once, by one task, and written.
A cell is a ball around its pivot, so a query can leave out a whole cell as it can a subtree:

* by the triangle inequality no vector of a ball (centre c, radius r) has an inner product with q above q.c + |q| r;
* nor, with d the least distance from q that the ball's distances from c allow and M its longest vector, above
  (|q|^2 + M^2 - d^2) / 2.

A part is left out if either bound is below the k-th best product found so far. ``factor`` shrinks r, and stretches d by
its inverse: factor one restores exact search, less is faster and may miss. Neither bound needs vectors of one length.
Queries first visit the cell of their best bound, and then, with what they found there, every other cell that isn't
left out. Leaves choose by exact inner product and id, ties included; equal bounds and a hair for rounding stay open.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import parts_for, written

#: Vectors per shard, queries that meet a shard in one task and in one batch of it, vectors per leaf.
SHARD = 8192
QUERY_BLOCK = 16384
BATCH = 1024
LEAF = 128
FACTOR = 1.0
#: Pivots at most: what every task is sent, whatever the size of the table.
CELLS = 1024


def _far(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances from each q to each x, by differences, so none is lost to cancellation."""
    out = np.empty((len(q), len(x)))
    for i in range(0, len(x), max((1 << 21) // max(q.size, 1), 1)):
        part = x[i : i + max((1 << 21) // max(q.size, 1), 1)]
        out[:, i : i + len(part)] = np.sqrt(np.square(q[:, None, :] - part[None]).sum(2))
    return out


def _bounds(q_far: np.ndarray, q_dot: np.ndarray, q_len: np.ndarray, low, high, longest, factor: float) -> np.ndarray:
    """Largest inner product that a vector may have whose distance from a centre is ``low`` to ``high``, of queries at
    the distance ``q_far`` from it; with a hair for rounding. What overflows is no bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        ball = q_dot + factor * q_len * high
        least = np.maximum(np.maximum(low - q_far, q_far - high), 0) / max(factor, 1e-9)
        shell = (q_len * q_len + longest * longest - least * least) / 2
        hair = 1e-9 * (q_len + longest + high) * (q_len + longest + high)
        out = np.minimum(np.where(np.isnan(ball), np.inf, ball), np.where(np.isnan(shell), np.inf, shell)) + hair
    return np.where(np.isnan(out), np.inf, out)


class VpTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.x, self.ids, self.leaf = x, ids, leaf
        self.lengths = np.sqrt(np.square(x).sum(1))
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(x)))
        del self.random

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v = rows[self.random.integers(len(rows))]
        far = _far(self.x[v : v + 1], self.x[rows])[0]
        order = np.argpartition(far, len(rows) // 2)
        # (least and greatest distance from the vantage point, longest vector, subtree) of each side
        return (v, *((far[side].min(), far[side].max(), self.lengths[rows[side]].max(), self._grow(rows[side])) for side in (order[: len(rows) // 2], order[len(rows) // 2 :])))

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, skip: np.ndarray | None = None, floor: np.ndarray | None = None):
        """(inner products, rows) of the k first of each query by inner product, ties by the smaller id; missing ones
        are -inf and -1. ``skip``: the id that each query must not find. ``floor``: products below it need not be found."""
        self.q, self.k, self.factor, self.skip = q, k, factor, skip
        self.q_len = np.sqrt(np.square(q).sum(1))
        self.best, self.rows = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.visited = 0
        if len(self.x):
            self._visit(self.root, np.arange(len(q)))
        return self.best, self.rows

    def _least(self, active: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[active].min(1), self.floor[active])

    def _products(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of pairs of a query and a row, in one order of summation: equal vectors have equal ones."""
        step = max((1 << 22) // max(self.x.shape[1], 1), 1)
        return np.concatenate([np.zeros(0), *((self.q[at[i : i + step]] * self.x[rows[i : i + step]]).sum(1) for i in range(0, len(at), step))])

    def _leaf(self, node: np.ndarray, active: np.ndarray) -> None:
        rough = self.q[active] @ self.x[node].T
        self.visited += rough.size
        with np.errstate(over="ignore", invalid="ignore"):
            hair = 16 * (self.x.shape[1] + 4) * np.finfo(float).eps * self.q_len[active] * self.lengths[node].max()
            hair = np.where(np.isfinite(hair), hair, np.inf)
        rough = np.where(np.isnan(rough), np.inf, rough)
        if self.skip is not None:
            rough[self.ids[node][None, :] == self.skip[active, None]] = -np.inf
        # ties at the k-th place stay, and what rounding could bring there
        least = self._least(active)
        if len(node) >= self.k:
            least = np.maximum(least, np.partition(rough, len(node) - self.k, 1)[:, len(node) - self.k])
        with np.errstate(invalid="ignore"):
            cut = least - 2 * hair
        at, column = np.nonzero(((rough >= cut[:, None]) | np.isnan(cut)[:, None]) & (rough > -np.inf))
        if not len(at):
            return
        touched = np.unique(at)
        mine = active[touched]
        query = np.concatenate([np.searchsorted(touched, at), np.repeat(np.arange(len(touched)), self.k)])
        rows = np.concatenate([node[column], self.rows[mine].ravel()])
        score = np.concatenate([self._products(active[at], node[column]), self.best[mine].ravel()])
        order = np.lexsort((self.ids[rows], -score, query))
        query, rows, score = query[order], rows[order], score[order]
        counts = np.bincount(query)
        place = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = place < self.k  # at least k of each: those of ``best``
        self.best[mine], self.rows[mine] = score[keep].reshape(-1, self.k), rows[keep].reshape(-1, self.k)

    def _visit(self, node, active: np.ndarray) -> None:
        if not isinstance(node, tuple):
            self._leaf(node, active)
            return
        v, *sides = node
        far = _far(self.q[active], self.x[v : v + 1])[:, 0]
        dot = self.q[active] @ self.x[v]
        bound = [_bounds(far, dot, self.q_len[active], low, high, longest, self.factor) for low, high, longest, _ in sides]
        first = bound[0] >= bound[1]
        # the side of the greater bound first
        for i, turn in ((0, first), (1, ~first), (1, first), (0, ~first)):
            go = turn & (bound[i] >= self._least(active))
            if go.any():
                self._visit(sides[i][3], active[go])


def _vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def _celled(rows: DataFrame, pivots) -> DataFrame:
    """``rows`` with the cell of the nearest pivot and the distance from it."""

    def run(batches):
        points = pivots.value
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cell, far, length = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, own = _vectors(batch.column(1).take(pa.array(at)), size), points[size]
                for a in range(0, len(at), 1024):
                    part = x[a : a + 1024]
                    nearest_ = _nearest_pivot(part, own[1])
                    cell[at[a : a + 1024]] = own[0] + nearest_
                    far[at[a : a + 1024]] = np.sqrt(np.square(part - own[1][nearest_]).sum(1))
                length[at] = np.sqrt(np.square(x).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(length)], ["vec_id", "v", "size", "cell", "far", "length"])

    return rows.select("vec_id", "v", "size").mapInArrow(run, "vec_id long, v array<double>, size int, cell long, far double, length double")


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Which cell a vector is in decides nothing but speed, so rounding may choose."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.square(pivots).sum(1) - 2 * (x @ pivots.T), nan=np.inf).argmin(1)


def _pivots(rows: DataFrame, cells: int) -> dict[int, tuple[int, np.ndarray]]:
    """First cell number and pivots of each dimension: vectors of least hashed ids, ``cells`` in all, but one for each
    dimension at least (a table has few)."""
    per_size = Window.partitionBy("size").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = rows.withColumn("k", F.row_number().over(per_size)).where(F.col("k") <= cells).select("size", "k", "v")
    found: dict[int, list] = {}
    for r in some.orderBy("k", "size").limit(cells).collect():
        found.setdefault(r["size"], []).append(r["v"])
    for r in some.where("k = 1").collect():
        found.setdefault(r["size"], [r["v"]])
    out, first = {}, 0
    for size in sorted(found):
        points = np.unique(np.array(found[size]), axis=0)
        out[size] = (first, points)
        first += len(points)
    return out


def nearest(df: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, shard: int = SHARD, cells: int = CELLS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every``, its ``k``
    nearest other rows by inner product in double precision, nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; those
    of another dimension than the query's are no candidates. Rows with the same id as the query are none either; other
    rows with one id are candidates each. With fewer than ``k`` candidates all are returned; query rows with one id get
    ``k`` together. An empty table gives an empty result; other columns are ignored.

    The number of shards follows the table. A block of queries meets a shard in a task of its own; at most ``k`` rows of
    a query come back from it. A cell that holds a third of all vectors has a third of the shards.
    """
    spark = df.sparkSession
    rows = _usable(df, id_col, vector_col)
    n = rows.count()
    pivots = spark.sparkContext.broadcast(_pivots(rows, min(cells, parts_for(n, shard, 1))))
    celled = written(_celled(rows, pivots), "cells")
    # of each cell: its shards, distances and longest vector; as many rows as there are pivots
    facts = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("length").alias("longest")).collect()}
    about = spark.sparkContext.broadcast({c: (parts_for(r["n"], shard, 1), r["low"], r["high"], r["longest"]) for c, r in facts.items()})
    dealt = spark.createDataFrame([(c, v[0]) for c, v in about.value.items()], "cell long, shards int")
    shards = celled.join(F.broadcast(dealt), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        tree = VpTree(_vectors(table["v"], size), table["vec_id"].to_numpy())
        return pa.table([table["cell"][:1], table["shard"][:1], pa.array([pickle.dumps(tree)], pa.binary())], ["cell", "shard", "tree"])

    trees = written(shards.select("cell", "shard", "size", "vec_id", "v").groupBy("cell", "shard").applyInArrow(build, "cell long, shard int, tree binary"), "trees")
    blocks = parts_for(n // every, QUERY_BLOCK, 1)
    asking = celled.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", "size", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def bounds(batch):
        """(rows, their cells, bounds on their inner products with each cell's vectors) of runs of rows of one dimension."""
        sizes = batch.column(2).to_numpy()
        for size in np.unique(sizes).tolist():
            base, points = pivots.value[size]
            own = [c for c in range(base, base + len(points)) if c in about.value]
            _, low, high, longest = (np.array(x) for x in zip(*(about.value[c] for c in own), strict=True))
            at = np.flatnonzero(sizes == size)
            for a in range(0, len(at), 256):
                some = at[a : a + 256]
                q, centres = _vectors(batch.column(1).take(pa.array(some)), size), points[np.array(own) - base]
                q_len = np.sqrt(np.square(q).sum(1))[:, None]
                yield some, np.array(own), _bounds(_far(q, centres), q @ centres.T, q_len, low, high, longest, factor)

    def homes(batches):
        """Each query with the cell of its best bound, which it visits first."""
        for batch in batches:
            home = np.zeros(batch.num_rows, np.int64)
            for some, own, bound in bounds(batch):
                home[some] = own[bound.argmax(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], ["vec_id", "v", "size", "block", "home"])

    queries = written(asking.mapInArrow(homes, "vec_id long, v array<double>, size int, block int, home long").withColumn("q", F.monotonically_increasing_id()), "queries")

    def onward(batches):
        """(q, cell, floor) of the other cells that may hold something nearer than what was found at home."""
        for batch in batches:
            floors, home = batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            for some, own, bound in bounds(batch):
                i, c = np.nonzero((bound >= floors[some, None]) & (own[None] != home[some, None]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some[i])), pa.array(own[c].astype(np.int64)), pa.array(floors[some][i].astype(float))], ["q", "cell", "floor"])

    def answer(questions: pa.Table, index: pa.Table) -> pa.Table:
        out = [[], [], []]
        if questions.num_rows and index.num_rows:
            tree = pickle.loads(index["tree"][0].as_py())
            q, q_ids, floors = _vectors(questions["v"], questions["size"][0].as_py()), questions["vec_id"].to_numpy(), questions["floor"].to_numpy()
            for at in range(0, len(q), BATCH):
                part = slice(at, at + BATCH)
                scores, found = tree.search(q[part], k, factor, q_ids[part], floors[part])
                at_q, at_k = np.nonzero(found >= 0)
                out[0].append(q_ids[part][at_q])
                out[1].append(tree.ids[found[at_q, at_k]])
                out[2].append(scores[at_q, at_k])
        columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def found_by(visits: DataFrame) -> DataFrame:
        """Of visits (q, cell, floor): a tree goes to the blocks of queries that visit its cell, and to no others."""
        visits = written(visits.join(queries.select("q", "block"), "q"), "visits")
        placed = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        keys = ["cell", "shard", "block"]
        asked = visits.join(placed, "cell").join(queries.select("q", "vec_id", "v", "size"), "q").select(*keys, "vec_id", "v", "size", "floor")
        sent = trees.join(visits.select("cell", "block").distinct(), "cell").select(*(F.col(c).alias(c) for c in keys), "tree")
        return asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(answer, "query_id long, vec_id long, score double")

    near = written(found_by(queries.select("q", F.col("home").alias("cell"), F.lit(float("-inf")).alias("floor"))), "home")
    floor = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).alias("floor"))
    rest = queries.join(floor, "vec_id", "left").select("q", "v", "size", "floor", "home")
    return _ranked(near.unionByName(found_by(rest.mapInArrow(onward, "q long, cell long, floor double"))), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rank: Column = F.row_number().over(order)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
