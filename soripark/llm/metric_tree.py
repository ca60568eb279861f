"""Exact top-k inner products by best-first search in M-trees.

The largest inner product is the smallest distance once a coordinate is added
that brings every stored vector to one length: |q - x|^2 = |q|^2 + M^2 - 2 q.x.
Each shard is an M-tree of pages.  An entry holds a routing vector, the radius
that covers what is below it and its distance to the page's own routing vector.
Search opens pages by least possible distance; the triangle inequality over the
stored parent distances leaves out entries before their distance is computed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import table
from soripark.llm.vectors import dealt, matrix, nearest, searched, usable

SHARD_ROWS = 16384
PAGE = 256
#: Squared lengths, and products of lengths, below this are exact in doubles; longer vectors or queries are scanned in Python integers.
EXACT = float(1 << 52)
PAGES = "dim int, shard int, page int, leaf boolean, vectors binary, ids binary, radii binary, to_parent binary"


def build(ids: np.ndarray, rows: np.ndarray) -> list[dict]:
    """Pages of one M-tree over integer vectors; page 0 is the root.  Equal vectors may fill any number of pages."""
    norms = (rows.astype(float) ** 2).sum(1)
    if norms.max() >= EXACT:
        return [{"leaf": True, "vectors": rows, "ids": ids, "radii": None, "to_parent": None}]
    lifted = np.column_stack([rows, np.sqrt(norms.max() - norms)])
    pages: list[dict] = []

    def page(members: np.ndarray, router: np.ndarray | None) -> tuple[int, int]:
        """Writes the page of these rows and what is below; its number and its smallest id."""
        number = len(pages)
        pages.append({})
        near = lambda at: np.zeros(len(at)) if router is None else np.sqrt(((at - router) ** 2).sum(1))
        if len(members) <= PAGE:
            members = members[np.argsort(ids[members])]
            pages[number] = {"leaf": True, "vectors": lifted[members], "ids": ids[members], "radii": None, "to_parent": near(lifted[members])}
            return number, int(ids[members].min())
        own = lifted[members]
        routers = own[np.linspace(0, len(own) - 1, min(PAGE, -(-2 * len(own) // PAGE))).astype(int)]
        routers = np.unique(routers, axis=0)
        if len(routers) == 1 and (own == routers[0]).all():
            parts = [members[i : i + max(PAGE, -(-len(members) // PAGE))] for i in range(0, len(members), max(PAGE, -(-len(members) // PAGE)))]
            centres = [routers[0]] * len(parts)
        else:
            if len(routers) == 1:
                routers = np.stack([routers[0], own[((own - routers[0]) ** 2).sum(1).argmax()]])
            squared = (own**2).sum(1)[:, None] - 2 * own @ routers.T + (routers**2).sum(1)
            which = squared.argmin(1)
            parts, centres = [], []
            for i in range(len(routers)):
                if (which == i).any():
                    parts.append(members[which == i])
                    centres.append(routers[i])
        radii, children, least = [], [], []
        for part, centre in zip(parts, centres):
            radii.append(np.sqrt(((lifted[part] - centre) ** 2).sum(1)).max())
            child, small = page(part, centre)
            children.append(child)
            least.append(small)
        centres = np.stack(centres)
        pages[number] = {"leaf": False, "vectors": centres, "ids": np.column_stack([children, least]), "radii": np.array(radii), "to_parent": near(centres)}
        return number, min(least)

    page(np.argsort(ids, kind="stable"), None)
    return pages


def search(pages: list[dict], query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
    """Up to k (score, vec_id) of one tree, best first, ties to the smaller id, the query's own id left out."""
    if pages[0]["to_parent"] is None:
        exact = pages[0]["vectors"].astype(object) @ query.astype(object)
        return sorted(((int(s), int(i)) for s, i in zip(exact, pages[0]["ids"]) if i != query_id), key=lambda x: (-x[0], x[1]))[:k]
    q = np.append(query.astype(float), 0.0)
    square = float(q @ q)
    limit = float((pages[0]["vectors"][0] ** 2).sum())  # every stored vector has this squared length
    if square * limit >= EXACT**2:  # no product of this query is sure to be exact in doubles: all leaves in Python integers
        leaves = [p for p in pages if p["leaf"]]
        whole_query = query.astype(object)
        scores = ((int(s), int(i)) for p in leaves for s, i in zip(p["vectors"][:, :-1].astype(np.int64).astype(object) @ whole_query, p["ids"]) if i != query_id)
        return sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
    best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
    worst = np.inf
    queue = [(0.0, 0, 0, None)]
    while queue:
        bound, least, number, to_router = heapq.heappop(queue)
        # squared distances differ by whole numbers, so a bound just below the worst distance can only tie
        if bound > worst + 1e-3 or (len(best) == k and bound > worst - 1e-6 and least > -best[0][1]):
            continue
        page = pages[number]
        if to_router is None:
            keep = np.arange(len(page["vectors"]))
        else:
            reach = np.abs(to_router - page["to_parent"]) - (0 if page["leaf"] else page["radii"])
            keep = np.flatnonzero(reach <= worst + 1e-3)
        if not len(keep):
            continue
        products = page["vectors"][keep] @ q
        if page["leaf"]:
            scores = np.rint(products).astype(np.int64)
            ids = page["ids"][keep]
            if len(best) == k:
                hopeful = np.flatnonzero(scores >= best[0][0])
            else:
                hopeful = np.argsort(-scores, kind="stable")
            for s, i in zip(scores[hopeful].tolist(), ids[hopeful].tolist()):
                if i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                worst = np.sqrt(max(0.0, square + limit - 2 * best[0][0]))
        else:
            own = page["vectors"][keep]
            distance = np.sqrt(np.maximum(0.0, square + (own**2).sum(1) - 2 * products))
            below = np.maximum(0.0, distance - page["radii"][keep])
            for b, d, (child, small) in zip(below.tolist(), distance.tolist(), page["ids"][keep].tolist()):
                if b <= worst + 1e-3:
                    heapq.heappush(queue, (b, small, child, d))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _packed(page: dict, number: int) -> tuple:
    blob = lambda x: None if x is None else np.ascontiguousarray(x).tobytes()
    vectors = page["vectors"].astype(np.int64 if page["to_parent"] is None else np.float64)
    return number, page["leaf"], blob(vectors), blob(page["ids"].astype(np.int64)), blob(page["radii"]), blob(page["to_parent"])


def _unpacked(row) -> dict:
    ids = np.frombuffer(row.ids, np.int64)
    if not row.leaf:
        ids = ids.reshape(-1, 2)
    n = len(ids)
    to_parent = None if row.to_parent is None else np.frombuffer(row.to_parent, np.float64)
    vectors = np.frombuffer(row.vectors, np.int64 if to_parent is None else np.float64).reshape(n, -1)
    return {"leaf": row.leaf, "vectors": vectors, "ids": ids, "radii": None if row.radii is None else np.frombuffer(row.radii, np.float64), "to_parent": to_parent}


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """M-tree pages of ``vectors`` (vec_id long, v array<long>), one row a page, and the number of shards."""
    rows, n = dealt(vectors, shard_rows)

    def pages(key, shard: pd.DataFrame) -> pd.DataFrame:
        built = build(shard["vec_id"].to_numpy(np.int64), matrix(shard["v"], np.int64))
        out = pd.DataFrame([_packed(p, i) for i, p in enumerate(built)], columns=["page", "leaf", "vectors", "ids", "radii", "to_parent"])
        return out.assign(dim=key[0], shard=key[1])[["dim", "shard", "page", "leaf", "vectors", "ids", "radii", "to_parent"]]

    return rows.groupBy("dim", "shard").applyInPandas(pages, PAGES), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    ``vectors``: vec_id, v (array<long>, not null); ``queries``: query_id, v.  A query's own id is
    no candidate.  Vectors meet queries of their own dimension only.  Fewer candidates than k: all.
    """
    pages, n = index(vectors, shard_rows)

    def run(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(asked):
            tree = [_unpacked(p) for p in pages.sort_values("page").itertuples()]
            for i, q in zip(asked["query_id"].tolist(), asked["v"]):
                out += [(i, v, s) for s, v in search(tree, np.asarray(q, np.int64), i, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = searched(pages, queries, n, run, "query_id long, vec_id long, score long")
    return nearest(found, k, F.col("score").desc())


def whole(vector: str, scale: int = 256):
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", whole("embedding").alias("v"))
    queries = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return top_k(rows, queries, 5)


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) as v from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
