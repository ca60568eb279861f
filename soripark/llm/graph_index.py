"""Approximate nearest neighbours in robust-pruned directed graphs, one graph a shard.

Points enter in doubling batches.  A greedy beam search over the graph so far
proposes neighbours; pruning keeps the nearest one and drops those that it is
``alpha`` times nearer to than the point itself, and so on, which leaves diverse
edges; reversed edges are added and pruned alike.  A query is a beam search in
every shard; the shards' results are merged and scored on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import table
from soripark.llm.vectors import dealt, matrix, nearest, searched, usable

SHARD_ROWS = 16384
DEGREE = 32
BUILD_BEAM = 64
QUERY_BEAM = 192
#: Searches start from the centre and this many other points, so a dense clump about the centre holds none back.
ENTRIES = 32
ALPHA = 1.2
BATCH = 512
#: Points nearer to each other than this share of a usual nearest distance are one node of the graph.
CLUMP = 0.1
NODES = "dim int, shard int, node int, entry boolean, vector binary, edges binary, ids binary, members binary"


def clumps(points: np.ndarray, share: float = CLUMP) -> np.ndarray:
    """For each point the point that stands for it: itself, or an earlier one very near to it.

    In a clump of very near points every beam would fill with its members and see nothing else.
    """
    n = len(points)
    near = np.full(n, np.inf)
    square = (points.astype(np.float64) ** 2).sum(1)
    for lot in range(0, n, BATCH):
        gap = square[lot : lot + BATCH, None] - 2.0 * points[lot : lot + BATCH].astype(np.float64) @ points.T.astype(np.float64) + square
        gap[np.arange(len(gap)), np.arange(lot, lot + len(gap))] = np.inf
        near[lot : lot + BATCH] = np.sqrt(np.maximum(gap.min(1), 0))
    own = np.arange(n)
    if n < 3:
        return own
    reach = share * np.quantile(near, 0.95)
    left = np.flatnonzero(near <= reach)
    while len(left):
        gap = points[left].astype(np.float64) - points[left[0]]
        close = np.einsum("ij,ij->i", gap, gap) <= reach * reach
        own[left[close]] = left[0]
        left = left[~close]
    return own


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ids and squared distances of the beam, nearest first (missing places hold -1 and inf), and how many distances were computed."""
    b = len(queries)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, len(points)), bool)
    entries = entries[:beam]
    gap = queries[:, None] - points[entries]
    first = np.einsum("ijk,ijk->ij", gap, gap)
    by = np.argsort(first, 1, kind="stable")
    ids[:, : len(entries)], dist[:, : len(entries)] = entries[by], np.take_along_axis(first, by, 1)
    done[:, : len(entries)] = False
    seen[:, entries] = True
    active = np.arange(b)
    while len(active):
        at = (~done[active]).argmax(1)
        done[active, at] = True
        next_ids = edges[ids[active, at]]
        fresh = next_ids >= 0
        fresh &= ~seen[active[:, None], next_ids]
        row, col = np.nonzero(fresh)
        seen[active[row], next_ids[row, col]] = True
        far = np.full(next_ids.shape, np.inf, np.float32)
        gap = points[next_ids[row, col]] - queries[active[row]]
        far[row, col] = np.einsum("ij,ij->i", gap, gap)
        all_dist = np.concatenate([dist[active], far], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_dist, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], next_ids], 1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], 1), order, 1)
        open_ = (~done[active] & np.isfinite(dist[active])).any(1)
        done[active] |= ~np.isfinite(dist[active])
        active = active[open_]
    ids[~np.isfinite(dist)] = -1
    return ids, dist, seen.sum(1)


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point ``of`` among its candidate ids (-1: none)."""
    valid = (candidates >= 0) & (candidates != of[:, None])
    own = points[of]
    at = points[np.where(valid, candidates, 0)]
    gap = at - own[:, None]
    dist = np.where(valid, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.inf)
    order = np.argsort(dist, 1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    candidates = np.take_along_axis(candidates, order, 1)
    at = np.take_along_axis(at, order[:, :, None], 1)
    alive = np.isfinite(dist)
    out = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, k] = candidates[rows, pick][some]
        chosen = at[rows, pick]
        gap = at - chosen[:, None]
        between = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        alive &= alpha * between > dist
        alive[rows, pick] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (len(points) x degree, -1: none) and the points at which searches begin."""
    n = len(points)
    centre = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    wide = np.full((n, 2 * degree), -1, np.int64)
    used = np.zeros(n, np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[centre], order[order != centre]])
    entries = order[: 1 + ENTRIES]
    begin = 1
    while begin < n:
        batch = order[begin : begin + min(begin, BATCH)]
        found, _, _ = beam_search(points, wide, entries[:begin], points[batch], beam)
        kept = robust_prune(points, batch, found, degree, alpha)
        wide[batch, :degree] = kept
        used[batch] = (kept >= 0).sum(1)
        source = np.repeat(batch, degree)[kept.ravel() >= 0]
        target = kept.ravel()[kept.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        fits = used[nodes] + count <= 2 * degree
        place = np.arange(len(target)) - np.repeat(first, count)
        easy = np.repeat(fits, count)
        wide[target[easy], (used[target] + place)[easy]] = source[easy]
        used[nodes[fits]] += count[fits]
        full = nodes[~fits]
        for lot in range(0, len(full), BATCH):
            these = full[lot : lot + BATCH]
            where = np.searchsorted(nodes, these)
            extra = np.full((len(these), int(count[where].max())), -1, np.int64)
            for i, w in enumerate(where):
                extra[i, : count[w]] = source[first[w] : first[w] + count[w]]
            kept = robust_prune(points, these, np.concatenate([wide[these], extra], 1), degree, alpha)
            wide[these] = -1
            wide[these, :degree] = kept
            used[these] = (kept >= 0).sum(1)
        begin += len(batch)
    edges = np.full((n, degree), -1, np.int64)
    for lot in range(0, n, BATCH):
        edges[lot : lot + BATCH] = robust_prune(points, np.arange(lot, min(n, lot + BATCH)), wide[lot : lot + BATCH], degree, alpha)
    return edges, entries


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """Graph nodes of ``vectors`` (vec_id, v array<float>): one row a node, with the ids and vectors that it stands for."""
    rows, n = dealt(vectors, shard_rows)

    def nodes(key, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("vec_id")
        every = matrix(shard["v"], np.float32)
        points, which = np.unique(every, axis=0, return_inverse=True)
        stands, which = np.unique(clumps(points)[which.ravel()], return_inverse=True)
        points = points[stands]
        edges, entries = build(points)
        ids = shard["vec_id"].to_numpy(np.int64)
        by = np.argsort(which, kind="stable")
        groups = np.split(by, np.cumsum(np.bincount(which, minlength=len(points)))[:-1])
        return pd.DataFrame({"dim": key[0], "shard": key[1], "node": np.arange(len(points)), "entry": np.isin(np.arange(len(points)), entries), "vector": [p.tobytes() for p in points],
                             "edges": [e.astype(np.int32).tobytes() for e in edges], "ids": [ids[g].tobytes() for g in groups], "members": [every[g].tobytes() for g in groups]})

    return rows.groupBy("dim", "shard").applyInPandas(nodes, NODES), n


def search(vectors: DataFrame, queries: DataFrame, k: int, beam: int = QUERY_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, ties to the smaller vec_id.

    A query's own id is no candidate; equal and very near vectors share a node and are all found with it.  Fewer
    candidates than k: all that are found.  Vectors meet queries of their own dimension only.
    """
    nodes, n = index(vectors, shard_rows)

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(asked):
            graph = graph.sort_values("node")
            points = np.stack([np.frombuffer(x, np.float32) for x in graph["vector"]])
            edges = np.stack([np.frombuffer(x, np.int32) for x in graph["edges"]]).astype(np.int64)
            ids = [np.frombuffer(x, np.int64) for x in graph["ids"]]
            members = [np.frombuffer(x, np.float32).reshape(len(i), -1) for x, i in zip(graph["members"], ids)]
            entries = np.flatnonzero(graph["entry"].to_numpy())
            query_ids, all_queries = asked["query_id"].to_numpy(np.int64), matrix(asked["v"], np.float32)
            for lot in range(0, len(asked), BATCH):
                own, q = query_ids[lot : lot + BATCH], all_queries[lot : lot + BATCH]
                found, _, _ = beam_search(points, edges, entries, q, max(beam, k + 1))
                for i, query, near in zip(own, q.astype(np.float64), found):
                    near = near[near >= 0].tolist()
                    at = np.concatenate([ids[x] for x in near])
                    exact = np.sqrt(((np.concatenate([members[x] for x in near]).astype(np.float64) - query) ** 2).sum(1))
                    order = np.lexsort((at, exact))[: k + 1]
                    out += [(int(i), v, d) for v, d in zip(at[order].tolist(), exact[order].tolist()) if v != i][:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = searched(nodes, queries, n, run, "query_id long, vec_id long, score double")
    return nearest(found, k, F.col("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").where(usable(v) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("v"))
    queries = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return search(rows, queries, 10)
