"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt into shards of a bounded size by a hash of their ids, so a shard is a random sample and many equal
vectors spread over all shards.  Each shard builds a directed graph over its distinct vectors: greedy searches propose
neighbours, and relaxed distance pruning keeps diverse edges.  Queries meet every shard in blocks; a beam search walks
the shard's graph, and what it has found is scored again in double precision on the original vectors.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketflow.llm.common import checkpointed

#: Vectors of a shard and queries of a block, about.
SHARD = 8192
QUERY_BLOCK = 4096
#: Edges that pruning leaves a node, width of the beam when building and when searching, and the slack of the pruning.
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
#: Edges a node may gather before it is pruned again, and nearest candidates that pruning looks at.
ROOM = 36
CANDIDATES = 80
#: Points inserted together, in rounds that double up to this.
_BATCH = 1024


class Graph:
    """A robust-pruned graph over unit vectors; all work is vectorised over a batch of points."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        self.x = np.ascontiguousarray(unit, np.float32)
        self.degree, self.alpha = degree, alpha
        n = len(self.x)
        self.edges = np.full((n, ROOM), -1, np.int32)
        self.entry = int(np.argmax(self.x @ self.x.mean(axis=0))) if n else 0
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]]) if n else order
        for slack in (1.0, alpha):  # the second pass, with slack, adds the long edges
            at, size = 1, 1
            while at < n:
                part = order[at:at + size]
                _, seen = self.search(self.x[part], beam, visited=True)
                self._link(part, seen, slack)
                at, size = at + size, min(2 * size, _BATCH)

    def search(self, q: np.ndarray, beam: int, visited: bool = False):
        """Nodes found for each query, nearest first, -1 where none; and all nodes whose edges were followed."""
        m, n = len(q), len(self.x)
        rows = np.arange(m)[:, None]
        ids = np.full((m, beam), -1, np.int32)
        near = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], near[:, 0], open_[:, 0] = self.entry, q @ self.x[self.entry], True
        known = np.zeros((m, n), bool)  # a batch and a shard are bounded
        known[:, self.entry] = True
        trail = []
        live = np.arange(m)
        while len(live):
            # Follow the nearest open node of every query that has one.
            at = open_[live].argmax(axis=1)  # the beam is sorted
            node = ids[live, at]
            open_[live, at] = False
            if visited:
                step = np.full(m, -1, np.int32)
                step[live] = node
                trail.append(step)
            nxt = self.edges[node]
            new = nxt >= 0
            new &= ~known[live[:, None], np.where(new, nxt, 0)]
            r, c = np.nonzero(new)
            known[live[r], nxt[r, c]] = True
            got = np.full(nxt.shape, -np.inf, np.float32)
            if len(r):
                got[r, c] = np.einsum("ij,ij->i", q[live[r]], self.x[nxt[r, c]])
            all_near = np.concatenate([near[live], got], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            k = rows[:len(live)]
            near[live] = all_near[k, order]
            ids[live] = np.where(np.isfinite(near[live]), np.concatenate([ids[live], nxt], axis=1)[k, order], -1)
            open_[live] = np.concatenate([open_[live], new], axis=1)[k, order] & (ids[live] >= 0)
            live = live[open_[live].any(axis=1)]
        return ids, np.stack(trail, axis=1) if trail else np.zeros((m, 0), np.int32)

    def _prune(self, points: np.ndarray, candidates: np.ndarray, slack: float) -> np.ndarray:
        """Robust pruning: the nearest candidate stays and drops those that are nearer to it, by the slack, than to the point."""
        m, k = candidates.shape
        c = np.sort(candidates, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == points[:, None]] = -1
        v = self.x[np.where(c >= 0, c, 0)]
        to_point = 1 - np.einsum("mkd,md->mk", v, self.x[points])
        to_point[c < 0] = np.inf
        order = np.argsort(to_point, axis=1, kind="stable")[:, :CANDIDATES]
        pick = np.arange(m)[:, None]
        c, v, to_point = c[pick, order], v[pick, order], to_point[pick, order]
        between = 1 - v @ v.transpose(0, 2, 1)
        alive = c >= 0
        out = np.full((m, ROOM), -1, np.int32)
        for slot in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            r = np.flatnonzero(some)
            out[r, slot] = c[r, first[r]]
            alive[r] &= slack * between[r, first[r]] > to_point[r]
            alive[r, first[r]] = False
        return out

    def _link(self, points: np.ndarray, seen: np.ndarray, slack: float) -> None:
        for a in range(0, len(points), 256):  # distances between candidates are the largest array
            p = points[a:a + 256]
            self.edges[p] = self._prune(p, np.concatenate([seen[a:a + 256], self.edges[p]], axis=1), slack)
        # Edges back; nodes that get too many are pruned again.
        out = self.edges[points]
        src = np.repeat(points, ROOM)[out.ravel() >= 0].astype(np.int32)
        dst = out.ravel()[out.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        start = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(dst)))
        while len(start):
            # A node that many point to takes them in turns; nodes with about as many stand together.
            take = np.minimum(count, CANDIDATES)
            by = np.argsort(take, kind="stable")
            for a in range(0, len(by), 512):
                part = by[a:a + 512]
                node, n = dst[start[part]], take[part]
                inside = np.arange(n[-1]) < n[:, None]
                more = np.where(inside, src[np.where(inside, start[part][:, None] + np.arange(n[-1]), 0)], -1)
                both = -np.sort(-np.concatenate([self.edges[node], more], axis=1), axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                full = (both >= 0).sum(axis=1) > ROOM
                self.edges[node[~full]] = -np.sort(-both[~full], axis=1)[:, :ROOM]
                if full.any():
                    self.edges[node[full]] = self._prune(node[full], both[full], slack)
            start, count = (start + take)[count > take], (count - take)[count > take]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec array<double>, dim) without vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col("vec")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
            .withColumn("dim", F.size("vec")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(-1, dim), np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by their largest component, so that no square over- or underflows."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    s = _scaled(x)
    return s / np.sqrt((s * s).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision and the same for equal rows."""
    q, x = _scaled(q), _scaled(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _build(table: pa.Table) -> pa.Table:
    """One row per shard: its ids, vectors, distinct vectors with the ids of each, and edges."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    ids, x = table["id"].to_numpy(), _matrix(table["vec"], dim)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order] + 0.0
    _, first, of = np.unique(x.view(np.dtype((np.void, 8 * dim))).ravel(), return_index=True, return_inverse=True)
    graph = Graph(_unit(x[first]))
    members = np.argsort(of, kind="stable")  # ids of equal vectors stand together, smallest first
    count = np.bincount(of)
    raw = lambda a, t: pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary())
    return pa.table({"shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": raw(ids[members], np.int64),
                     "count": raw(count, np.int64), "vectors": raw(x[first], np.float64), "edges": raw(graph.edges, np.int32),
                     "entry": pa.array([graph.entry], pa.int32())})


def build_index(vectors: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """The graph of every shard, one row each, written to the shared checkpoint folder."""
    shards = vectors.count() // shard_size + 1
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return checkpointed(dealt.groupBy("shard", "dim").applyInArrow(
        _build, "shard long, dim int, ids binary, count binary, vectors binary, edges binary, entry int"))


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block_size: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of all shards for each query, without the query itself."""
    blocks = queries.count() // block_size + 1
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select("id", "vec", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), each(shards).alias("shard"))
    graphs = index.select("*", each(blocks).alias("block"))

    def walk(graph: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not graph.num_rows or not asked.num_rows:
            return none
        dim = graph["dim"][0].as_py()
        load = lambda c, t: np.frombuffer(graph[c][0].as_py(), t)
        ids, count, x = load("ids", np.int64), load("count", np.int64), load("vectors", np.float64).reshape(-1, dim)
        g = Graph.__new__(Graph)
        g.x, g.edges, g.entry = _unit(x).astype(np.float32), load("edges", np.int32).reshape(len(x), -1), graph["entry"][0].as_py()
        start = np.cumsum(count) - count
        q_ids, q = asked["id"].to_numpy(), _matrix(asked["vec"], dim)
        out = []
        for a in range(0, len(q), _BATCH):
            part, who = q[a:a + _BATCH], q_ids[a:a + _BATCH]
            found, _ = g.search(_unit(part).astype(np.float32), max(beam, k + 1))
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            score = cosine(part[r], x[node])
            # Of equal vectors only the smallest ids can be among the k nearest.
            few = np.minimum(count[node], k + 1)
            row = np.repeat(np.arange(len(node)), few)
            vec = ids[start[node][row] + np.arange(len(row)) - np.repeat(np.cumsum(few) - few, few)]
            row, vec = row[vec != who[r][row]], vec[vec != who[r][row]]
            out.append((who[r][row], vec, score[row]))
        query, vec, score = (np.concatenate(z) for z in zip(*out))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        top = place < k
        return pa.table({"query_id": pa.array(query[top]), "vec_id": pa.array(vec[top]), "score": pa.array(score[top])})

    key = ("shard", "dim", "block")
    found = graphs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(walk, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            beam: int = SEARCH_BEAM, shard_size: int = SHARD) -> DataFrame:
    """Build the index over ``vectors`` and search it for ``queries`` (same columns, ids of the same kind).

    Rows whose id is null or whose vector cannot be used take no part, on either side; vectors meet only vectors of
    their own length; fewer candidates than ``k`` are all returned.  Rows that repeat an id count as rows of their own,
    except that no row with the query's id is returned.  Empty tables give an empty result.
    """
    index = build_index(usable(vectors, id_col, vec_col), shard_size)
    return search(index, usable(queries, id_col, vec_col), k, beam)
