"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of a bounded size. A shard's graph grows in
batches: greedy searches from fixed entry points propose neighbours for the new
vectors, robust pruning keeps a proposal only while no kept, ``ALPHA`` times
nearer neighbour stands before it, and edges are added both ways. Queries run a
beam search in every shard, in blocks; the nearest of all shards win.

Searches advance many vectors at once, so numpy does the work in a few calls per
step. Distances are squared Euclidean in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4096  # vectors, about; also bounds a task
DEGREE, BEAM, ALPHA = 24, 48, 1.2
QUERY_BEAM = 112
ENTRIES, BATCH = 16, 256


def _nearer(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of ``x[ids[i, j]]`` to ``q[i]``; infinite where ids < 0."""
    gap = x[ids] - q[:, None, :]
    d = np.einsum("ijk,ijk->ij", gap, gap)
    d[ids < 0] = np.inf
    return d


class PrunedGraph:
    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x = x
        n = len(x)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, DEGREE), -1, np.int64)
        middle = ((x - x.mean(0)) ** 2).sum(1).argmin()
        order = rng.permutation(n)
        order = np.concatenate(([middle], order[order != middle]))
        self.entries = order[:ENTRIES]
        first = order[:min(n, 2 * DEGREE)]
        self._link(first, np.tile(first, (len(first), 1)))
        done, batch = len(first), DEGREE
        while done < n:
            new = order[done:done + batch]
            found, _ = self.search(x[new], BEAM)
            self._link(new, found)
            done += len(new)
            batch = min(BATCH, done)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ids and squared distances, nearest first, by beam search."""
        n, rows = len(self.x), np.arange(len(q))
        ids = np.full((len(q), beam), -1)
        start = self.entries[:beam]
        ids[:, :len(start)] = start
        dist = _nearer(self.x, q, ids)
        open_ = ids >= 0
        seen = np.zeros((len(q), n + 1), bool)  # column n takes the places without an id
        seen[:, start] = True
        live = rows
        while len(live):
            # two nodes at a time: the nearest that are not expanded
            waiting = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(waiting, 1, 1)[:, :2] if beam > 2 else waiting.argmin(1)[:, None]
            valid = np.isfinite(np.take_along_axis(waiting, pick, 1))
            active = valid.any(1)
            live, pick, valid = live[active], pick[active], valid[active]
            if not len(live):
                break
            open_[live[:, None], pick] &= ~valid
            node = np.where(valid, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(node[:, :, None] >= 0, self.edges[node], -1).reshape(len(live), -1)
            at = np.where(near >= 0, near, n)
            old = seen[live[:, None], at]
            near[old] = -1
            seen[live[:, None], at] = True
            seen[live, n] = False
            # a node that both picks point to counts once
            order = near.argsort(1, kind="stable")
            sorted_ = np.take_along_axis(near, order, 1)
            twice = np.zeros_like(sorted_, bool)
            twice[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
            sorted_[twice] = -1
            d = _nearer(self.x, q[live], sorted_)
            all_d = np.concatenate((dist[live], d), 1)
            all_i = np.concatenate((ids[live], sorted_), 1)
            all_o = np.concatenate((open_[live], sorted_ >= 0), 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            open_[live] = np.take_along_axis(all_o, best, 1)
        order = np.argsort(dist, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def _prune(self, points: np.ndarray, proposals: np.ndarray) -> np.ndarray:
        """Robust pruning of each point's proposals (-1: none) to DEGREE at most."""
        ids = np.where(proposals == points[:, None], -1, proposals)
        ids = np.sort(ids, 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        d = _nearer(self.x, self.x[points], ids)
        order = np.argsort(d, 1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        v = self.x[ids]
        square = np.einsum("ijk,ijk->ij", v, v)
        between = square[:, :, None] + square[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        left = ids >= 0
        out = np.full((len(points), DEGREE), -1, np.int64)
        rows = np.arange(len(points))
        for k in range(DEGREE):
            pick = left.argmax(1)  # nearest first
            any_ = left[rows, pick]
            if not any_.any():
                break
            out[any_, k] = ids[any_, pick[any_]]
            # squared distances: relaxed by ALPHA squared
            left &= ~((ALPHA * ALPHA * between[rows, pick] <= d) & any_[:, None])
            left[rows, pick] = False
        return out

    def _link(self, points: np.ndarray, proposals: np.ndarray) -> None:
        kept = self._prune(points, proposals)
        self.edges[points] = kept
        # and back: free places first, pruning where there are none
        source = np.repeat(points, kept.shape[1])
        target = kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), DEGREE + min(int(count.max(initial=0)), 4 * DEGREE)), -1, np.int64)
        wide[:, :DEGREE] = self.edges[nodes]
        for i, (a, c) in enumerate(zip(first, count)):
            new = source[a:a + c][:wide.shape[1] - DEGREE]
            wide[i, DEGREE:DEGREE + len(new)] = new
        for i in range(0, len(nodes), 512):
            self.edges[nodes[i:i + 512]] = self._prune(nodes[i:i + 512], wide[i:i + 512])


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors as doubles, without null ids, null or zero vectors,
    and vectors that hold null or non-finite components; equal rows count once."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(ok, F.lit(False)))
            .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k``
    nearest found among ``vectors`` (both as ``usable`` gives them), without the row of
    the query's own id; nearest first, ties to the smaller id. Vectors of another
    length than the query's are none of its candidates. Empty tables give an empty one.

    Equal vectors enter a graph once, with their ``k + 1`` least ids: no answer
    can name more of them.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    nodes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    n_shards = max(1, -(-vectors.count() // SHARD))
    node = nodes.select(F.pmod(F.xxhash64("v"), F.lit(n_shards).cast("long")).alias("shard"), F.size("v").alias("dim"), "v", "ids",
                        F.lit(None).cast("long").alias("query_id"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
                           F.size("v").alias("dim"), "v", F.lit(None).cast("array<long>").alias("ids"),
                           F.col("vec_id").alias("query_id"))

    def run(table: pa.Table) -> pa.Table:
        query = np.array(table.column("query_id").is_valid())
        x = np.array(table.column("v").combine_chunks().flatten()).reshape(len(table), -1)
        out = {"query_id": [], "ids": [], "score": []}
        nodes_at, asked_at = np.flatnonzero(~query), np.flatnonzero(query)
        if len(nodes_at) and len(asked_at):
            graph = PrunedGraph(x[nodes_at])
            ids = table.column("ids").combine_chunks()
            beam = max(QUERY_BEAM, 4 * (k + 1))
            for i in range(0, len(asked_at), BATCH):
                q = asked_at[i:i + BATCH]
                found, _ = graph.search(x[q], beam)
                found = found[:, :k + 1]
                near, far = np.nonzero(found >= 0)
                at = nodes_at[found[near, far]]
                out["query_id"].append(np.array(table.column("query_id").take(pa.array(q[near]))))
                out["ids"].append(ids.take(pa.array(at)))
                out["score"].append(np.sqrt(((x[at] - x[q[near]]) ** 2).sum(1)))
        if not out["score"]:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())),
                             "score": pa.array([], pa.float64())})
        return pa.table({"query_id": np.concatenate(out["query_id"]), "ids": pa.chunked_array(out["ids"]),
                         "score": np.concatenate(out["score"])})

    hits = node.union(asked).groupBy("shard", "dim").applyInArrow(run, "query_id long, ids array<long>, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (hits.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
