"""Exact top-k inner-product search with MaxScore over shards of postings.

A component of a vector is a term: dimension and sign, its weight the component's size.  A query meets the postings whose
sign makes its product positive; what the other sign takes away can only lower a score, so the sum of the met terms' bounds
is a bound of the score.  Per shard and query the terms are ordered by bound; the longest run of small ones whose bounds
together stay below the k-th best score so far is non-essential.  Essential postings are traversed to gather candidates,
the other terms are probed from the largest bound down only for candidates that can still reach that score, and those
left are scored exactly.  Shards are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.session import materialize

K = 10
SCALE = 1024.0
QUERY_BLOCK = 1_024
SHARD_ROWS = 65_536
LEAST_SHARDS = 12
#: Products and sums below this are exact in doubles; larger components are scored in Python's integers.
EXACT = 2.0**53


class Shard:
    """Vectors of integers with their postings by dimension and sign."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.columns = np.ascontiguousarray(self.values.T)
        self.postings = [(np.flatnonzero(c > 0), np.flatnonzero(c < 0)) for c in self.columns]
        self.top = [(max(c.max(initial=0), 0), max((-c).max(initial=0), 0)) for c in self.columns]
        self.largest = np.abs(self.values).max(initial=0)

    def _exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.values[rows] @ q

    def search(self, query_id: int, q: np.ndarray, k: int = K) -> list[tuple[int, int]]:
        """``(id, score)`` of the k best rows with another id, ties to the smaller id."""
        if self.largest * np.abs(q).max(initial=0) * max(1, len(q)) >= EXACT:
            whole = [int(x) for x in q]
            scores = [(-sum(a * int(b) for a, b in zip(whole, v, strict=True)), int(i)) for i, v in zip(self.ids, self.values, strict=True) if i != query_id]
            return [(i, -s) for s, i in sorted(scores)[:k]]
        dims = np.flatnonzero(q)
        side = (q[dims] < 0).astype(int).tolist()
        bounds = np.array([abs(q[d]) * self.top[d][s] for d, s in zip(dims, side, strict=True)])
        order = np.argsort(bounds, kind="stable")
        below = np.concatenate([[0.0], np.cumsum(bounds[order])])  # what the smallest terms can add together
        theta = self._start(query_id, q, dims, side, bounds, k)
        first = int(np.searchsorted(below, theta, "left")) - 1 if theta > 0 else -1  # terms before it are non-essential
        acc = np.zeros(len(self.ids))
        if first < 0:
            candidates = np.arange(len(self.ids))  # no score is out of reach, not even one without a term
            first = 0
        else:
            candidates = None
        for j in range(len(order) - 1, first - 1, -1):
            d, s = int(dims[order[j]]), side[order[j]]
            some = self.postings[d][s]
            acc[some] += q[d] * self.columns[d][some]
        if candidates is None:
            candidates = np.flatnonzero(acc > 0)
        for j in range(first - 1, -1, -1):
            candidates = candidates[acc[candidates] + below[j + 1] >= theta]
            d = int(dims[order[j]])
            acc[candidates] += np.maximum(q[d] * self.columns[d][candidates], 0)
        candidates = candidates[(acc[candidates] >= theta) & (self.ids[candidates] != query_id)]
        scores = self._exact(candidates, q)
        best = np.lexsort((self.ids[candidates], -scores))[:k]
        return [(int(self.ids[candidates[b]]), int(scores[b])) for b in best]

    def _start(self, query_id: int, q: np.ndarray, dims: np.ndarray, side: list[int], bounds: np.ndarray, k: int) -> float:
        """A score that k rows are known to reach: of the rows that hold most of the largest terms."""
        if len(self.ids) <= 4 * k or not len(dims):
            return -np.inf
        some = np.zeros(len(self.ids))
        for j in np.argsort(-bounds, kind="stable")[: max(1, len(dims) // 2)].tolist():
            d = int(dims[j])
            rows = self.postings[d][side[j]]
            some[rows] += abs(q[d]) * np.abs(self.columns[d][rows])
        some[self.ids == query_id] = -np.inf
        rows = np.argpartition(-some, 2 * k)[: 2 * k]
        rows = rows[self.ids[rows] != query_id]
        return float(np.sort(self._exact(rows, q))[-k]) if len(rows) >= k else -np.inf


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 * x) of every component in double precision; shorter vectors end in zeros."""
    lens = np.array([len(x) for x in column], np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lens), dim))
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` its ``k`` best other rows.

    Null vectors, vectors that hold null or non-finite components and rows with a null id take no part; of vectors of
    different length the longer one's further components count as zero; an empty vector scores 0.  Rows that repeat an
    id are candidates each, but never for that id; as a query it stands once, with its smallest vector.  A score beyond BIGINT is given as its limit.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)
    queries = materialize(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    total, asked = rows.count(), queries.count()
    shards, blocks = max(LEAST_SHARDS, -(-total // SHARD_ROWS)), max(1, -(-asked // QUERY_BLOCK))
    at = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("shard", at(shards, 1)).withColumn("block", each(blocks))
    right = queries.withColumn("block", at(blocks, 2)).withColumn("shard", each(shards))

    def search(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if x.num_rows and y.num_rows:
            xv, yv = (t.column("v").combine_chunks() for t in (x, y))
            dim = max(max((len(v) for v in c), default=0) for c in (xv, yv))
            shard = Shard(x.column("id").to_numpy(), _integers(xv, dim))
            for q, v in zip(y.column("id").to_pylist(), _integers(yv, dim), strict=True):
                out += [(q, i, max(-(2**63), min(2**63 - 1, s))) for i, s in shard.search(q, v, k)]
        return pa.table({n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in SQL; vectors of one length are taken for granted, as in the supplied table.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs) WHERE rank <= 10
"""
