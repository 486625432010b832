"""Nearest neighbours by inner product with query-aware collision counting.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors, so the largest inner
product is the smallest distance. Each of a few random directions gives a sorted array of projections; there are no
buckets. Around a query's own projection a window is opened in each array and widened round by round (virtual
rehashing: only the new ends are read). A vector that lies in enough windows is verified against the query in double
precision. A query ends when its k-th best is nearer than the radius of the round, or when all vectors were verified.
Before it ends, the count is lowered so far that a vector as near as the k-th best reaches it almost surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

DIRECTIONS = 16
RADII = tuple(0.1 * 1.5**i for i in range(8))  # of the rounds; unrelated unit vectors are 1.41 apart, the last radius is 1.71
SHARE = 0.68  # of the windows a vector must lie in: as many as one at the radius itself lies in on average
SURE = 0.9999  # probability that a vector as near as the k-th best is verified before its query ends
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 2_048
ROWS = "query_id bigint, vec_id bigint, score double"


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def closing_count(radius: float, square: float) -> int:
    """The most windows of this radius that a vector at this squared distance lies in with probability SURE at least.

    Projections of a distance d are normal with deviation d and independent of each other.
    """
    p = math.erf(radius / math.sqrt(2 * square)) if square > 0 else 1.0
    tail = 0.0
    for m in range(DIRECTIONS, 0, -1):
        tail += math.comb(DIRECTIONS, m) * p**m * (1 - p) ** (DIRECTIONS - m)
        if tail >= SURE:
            return m
    return 0


class Index:
    """Sorted projections of a block. Equal vectors are one entry with all their ids in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, seed: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        places: dict[bytes, list[int]] = {}
        for i, v in enumerate(vectors):
            places.setdefault(v.tobytes(), []).append(i)
        self.ids = [np.unique(ids[p]) for p in places.values()]
        self.vectors = vectors[[p[0] for p in places.values()]]
        unit = self.vectors / norm
        rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, DIRECTIONS))
        projected = np.column_stack([unit, rest]) @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        self.norm = norm

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The k best of the block for each query, its own id left out: (query id, vec_ids, scores)."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        centre = np.column_stack([queries / lengths[:, None], np.zeros(len(queries))]) @ self.directions
        low = np.stack([[np.searchsorted(s, centre[:, j] - r, side="left") for r in RADII] for j, s in enumerate(self.sorted)])
        high = np.stack([[np.searchsorted(s, centre[:, j] + r, side="right") for r in RADII] for j, s in enumerate(self.sorted)])
        need = int(np.ceil(SHARE * DIRECTIONS))
        n = len(self.vectors)
        for q, (vector, own) in enumerate(zip(queries, query_ids, strict=True)):
            hits, seen = np.zeros(n, np.uint8), np.zeros(n, bool)
            ids, scores = np.zeros(0, np.int64), np.zeros(0)
            left = right = None
            for r, radius in enumerate(RADII):
                lo, hi = low[:, r, q].tolist(), high[:, r, q].tolist()
                for j, order in enumerate(self.order):
                    if left is None:
                        hits[order[lo[j] : hi[j]]] += 1
                    else:
                        hits[order[lo[j] : left[j]]] += 1
                        hits[order[right[j] : hi[j]]] += 1
                left, right = lo, hi
                ids, scores = self._verify(np.flatnonzero((hits >= need) & ~seen), seen, vector, own, ids, scores, k)
                if len(scores) >= k and (square := 2 - 2 * scores[k - 1] / (self.norm * lengths[q])) <= radius * radius:
                    ids, scores = self._verify(np.flatnonzero((hits >= closing_count(radius, square)) & ~seen), seen, vector, own, ids, scores, k)
                    break
            else:
                ids, scores = self._verify(np.flatnonzero(~seen), seen, vector, own, ids, scores, k)
            yield int(own), ids, scores

    def _verify(self, found: np.ndarray, seen: np.ndarray, vector: np.ndarray, own: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        seen[found] = True
        if not len(found):
            return ids, scores
        if len(found) > k:  # quick products first; those clearly too small need no exact one
            quick = self.vectors[found] @ vector
            cut = np.partition(quick, -k - 1)[-k - 1] if len(found) > k + 1 else -np.inf
            cut = max(cut, scores[k - 1] if len(scores) >= k else -np.inf)
            found = found[quick >= cut - 1e-9 * max(1.0, abs(cut))]
        exact = (self.vectors[found] * vector).sum(axis=1)
        more = [(s, i) for s, e in zip(exact.tolist(), found.tolist(), strict=True) for i in self.ids[e][: k + 1].tolist() if i != own]
        ids = np.concatenate([ids, np.array([i for _, i in more], np.int64)])
        scores = np.concatenate([scores, np.array([s for s, _ in more])])
        best = np.lexsort((ids, -scores))
        ids, scores = ids[best], scores[best]
        new = np.ones(len(ids), bool)  # one id may stand at several vectors of the same score
        new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        return ids[new][:k], scores[new][:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 7) -> DataFrame:
    """vectors, queries: vec_id, embedding. Returns query_id, rank (from 1), vec_id, score: each query's k best found.

    Candidates are all vectors but those with the query's own id; ties go to the smaller vec_id; fewer than k candidates
    are all returned. Repeated rows, of candidates and of queries, count once; an id with several vectors is near by each of
    them, and as a query it asks with each. Rows that are null, zero, or hold null or non-finite components take no part, nor do null ids;
    only vectors of the query's dimension are compared. Other columns are not read. The query set meets all vectors
    in blocks of fixed size; a block's index is built where it is searched.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).withColumn("dim", F.size("v"))

    data, asked = usable(vectors), usable(queries)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    totals = data.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("norm")).first()
    blocks = max(1, -(-totals["n"] // BLOCK_VECTORS))
    sheets = max(1, -(-asked.count() // BLOCK_QUERIES))
    norm = (totals["norm"] or 1.0) * (1 + 1e-12)

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        if not left.num_rows or not right.num_rows:
            return empty
        dim = left.column("dim")[0].as_py()
        index = Index(left.column("vec_id").to_numpy(), _matrix(left, dim), norm, seed)
        asked = {(i, v.tobytes()): n for n, (i, v) in enumerate(zip(right.column("vec_id").to_pylist(), _matrix(right, dim), strict=True))}
        once = np.array(sorted(asked.values()))
        parts = list(index.search(_matrix(right, dim)[once], right.column("vec_id").to_numpy()[once], k))
        return pa.table([pa.array(np.repeat([q for q, _, _ in parts], [len(i) for _, i, _ in parts]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in parts])), pa.array(np.concatenate([s for _, _, s in parts]))], names=names)

    key = ["dim", "block", "sheet"]
    left, right = dealt(data, "block", blocks, "sheet", sheets), dealt(asked, "sheet", sheets, "block", blocks)
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(cell, ROWS)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each block
    ranked = written(found, "neighbours").distinct().withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
