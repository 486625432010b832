"""Exact top-k inner-product search for many queries at once.

Documents are never paired with queries as rows. Bundles of query blocks meet groups of documents; a cell holds its
bundle, multiplies its blocks with one slice of document vectors after the other and keeps k candidates per query. So
k rows per query and document group leave the cells, and a window picks the final k. A document is sent once to each
bundle, not to each block. There is one way for all sizes, and no vector passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import top_per_group

QUERY_BYTES = 4 << 20  # of a block of query vectors
HELD_BYTES = 16 << 20  # of a bundle of such blocks: what a task holds beside one batch of documents
DOC_BYTES = 64 << 20   # of a group of documents: k rows for each query leave a group
TILE = 256             # query rows multiplied at a time
DOC_ROWS = 2048        # with so many documents
SHARED = 512           # categories that queries of a tile and documents share, multiplied at a time
DIGITS = 6             # scores are compared at this precision, ties broken by id


def _matrix(column) -> np.ndarray:
    """Arrow list column to a (rows, dim) matrix without a Python object per value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=m.copy(), where=length > 0)


def _ids(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class _Best:
    """Running k best documents per query, kept by tile so that a batch only sorts what it can change."""

    def __init__(self, k: int):
        self.k = k
        self.tiles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def floor(self, tile: int, rows: int) -> np.ndarray:
        """Score a document must reach to matter, per query of a tile."""
        out = np.full(rows, -np.inf)
        if tile in self.tiles:
            q, _, s = self.tiles[tile]
            last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, int)
            first = np.append(0, last[:-1] + 1) if len(q) else last
            full = last - first + 1 >= self.k
            out[q[last[full]] - tile] = s[last[full]]
        return out

    def add(self, tile: int, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        if tile in self.tiles:
            q, ids, s = (np.concatenate(x) for x in zip(self.tiles[tile], (q, ids, s)))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        self.tiles[tile] = q[keep], ids[keep], s[keep]


def _sparse(column, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Arrow list of structs (c, w) to rows, positions in ``known`` (all of this column when None), weights, ``known``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = column.flatten()
    keys = pc.struct_field(flat, "c")
    known = pc.unique(keys) if known is None else known
    at = pc.fill_null(pc.index_in(keys, value_set=known), -1).to_numpy(zero_copy_only=False)
    fit = at >= 0
    return rows[fit], at[fit], pc.struct_field(flat, "w").to_numpy(zero_copy_only=False)[fit], known


def _dense(rows: np.ndarray, at: np.ndarray, weights: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """The columns ``part`` (sorted) of a sparse matrix of n rows."""
    place = np.minimum(np.searchsorted(part, at), len(part) - 1)
    fit = part[place] == at
    out = np.zeros((n, len(part)))
    out[rows[fit], place[fit]] = weights[fit]
    return out


def _shared(q: tuple, d: tuple, at: int, n: int, docs: int) -> np.ndarray | float:
    """Inner products of the categories of n queries from ``at`` with those of a batch of documents."""
    (rows, cols, weights, _), out = q, 0.0
    own = slice(*np.searchsorted(rows, [at, at + n]))
    both = np.intersect1d(cols[own], d[1])
    for a in range(0, len(both), SHARED):
        part = both[a:a + SHARED]
        out = out + _dense(rows[own] - at, cols[own], weights[own], part, n) @ _dense(*d[:3], part, docs).T
    return out


def _score_block(best: _Best, queries: np.ndarray, qids: np.ndarray, docs: np.ndarray, ids: np.ndarray,
                 skip_self: bool, q_cats: tuple | None = None, d_cats: tuple | None = None) -> None:
    n = len(ids)
    if n == 0:
        return
    slack = 10.0 ** -DIGITS  # more than rounding adds
    for at in range(0, len(queries), TILE):
        s = queries[at:at + TILE] @ docs.T
        if q_cats is not None:
            s = s + _shared(q_cats, d_cats, at, len(s), n)
        if skip_self:
            s[qids[at:at + TILE, None] == ids[None, :]] = -np.inf
        cut = best.floor(at, len(s))
        if n > best.k and not np.isfinite(cut).all():  # some query has not met k documents yet
            cut = np.maximum(cut, np.partition(s, n - best.k, axis=1)[:, n - best.k])
        rows, cols = np.nonzero((s >= cut[:, None] - slack) & (s > -np.inf))
        if len(rows):
            best.add(at, rows + at, ids[cols], np.round(s[rows, cols], DIGITS) + 0.0)


def _emit(best: _Best, qids: pa.Array, names: pa.Schema) -> pa.RecordBatch:
    if not best.tiles:
        return pa.RecordBatch.from_pylist([], schema=names)
    q, ids, s = (np.concatenate(x) for x in zip(*best.tiles.values()))
    return pa.RecordBatch.from_arrays(
        [
            qids.take(pa.array(q)).cast(names.field(0).type),
            pa.array(ids).cast(names.field(1).type),
            pa.array(s, pa.float64()),
        ],
        schema=names,
    )


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def top_k(queries: DataFrame, docs: DataFrame, k: int, *, skip_self: bool = False, normalise: bool = True,
          query_bytes: int = QUERY_BYTES, doc_groups: int | None = None) -> DataFrame:
    """The k documents of highest inner product (cosine when ``normalise``) for every query.

    ``queries``: (query_id, vector); ``docs``: (doc_id, vector), any numeric array type, one dimension. Where both have
    ``categories`` (array<struct<c:string,w:double>>, a c once in a row), the product of these weights is added.
    Returns (query_id, doc_id, score, rank) with scores rounded to 6 places and ties broken by id.

    Queries are cut into blocks of ``query_bytes``, documents into ``doc_groups`` (of DOC_BYTES), so k rows for each
    query and 64 MB of documents leave the cells, however many partitions a shuffle has. Blocks share a cell up to
    HELD_BYTES, so that a document is copied for every 16 MB of queries, however small the blocks; there are fewer in a
    cell only where the cells would not occupy all cores. In a cell the queries come first and are held; document batches
    stream past them, block by block, against one running best each.
    """
    cats = ["categories"] if "categories" in queries.columns and "categories" in docs.columns else []
    q = queries.select("query_id", "vector", *cats).filter(F.col("vector").isNotNull())
    d = docs.select("doc_id", "vector", *cats).filter(F.col("vector").isNotNull())
    types = {"query_id": q.schema["query_id"].dataType, "doc_id": d.schema["doc_id"].dataType, "score": T.DoubleType()}
    schema = T.StructType([T.StructField(n, t) for n, t in types.items()])
    names = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    size = q.agg(F.count("*").alias("n"), (F.max(F.size("vector")) + (F.avg(F.size("categories")) * 4 if cats else 0)).alias("dim")).first()
    row_bytes = (size["dim"] or 1) * 8
    blocks = max(1, math.ceil(size["n"] * row_bytes / query_bytes))
    groups = doc_groups or max(1, math.ceil(d.count() * row_bytes / DOC_BYTES))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    bundles = min(blocks, max(math.ceil(size["n"] * row_bytes / HELD_BYTES), math.ceil(2 * cores / groups)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda n: F.lit(None).cast(types[n]).alias(n)
    vector = F.col("vector").cast("array<double>").alias("vector")
    block = place("query_id", blocks)
    asked = q.select(F.pmod(block, F.lit(bundles)).alias("qb"), spread(groups).alias("dg"), block.alias("block"), "query_id", none("doc_id"), vector, *cats)
    held = d.select(spread(bundles).alias("qb"), place("doc_id", groups).alias("dg"), F.lit(blocks).alias("block"), none("query_id"), "doc_id", vector, *cats)
    cells = asked.unionByName(held).repartition(bundles * groups, "qb", "dg").sortWithinPartitions("qb", "dg", "block")
    parts = cells.mapInArrow(_search_cells(k, blocks, skip_self, _unit if normalise else (lambda m: m), names), schema)
    return top_per_group(parts, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


class _Block:
    """A block of queries and its running best."""

    def __init__(self, parts: list[pa.RecordBatch], k: int, prep):
        table = pa.Table.from_batches(parts)
        self.names = table.column("query_id").combine_chunks()
        self.ids, self.vectors, self.best = _ids(self.names), prep(_matrix(table.column("vector"))), _Best(k)
        self.cats = _sparse(table.column("categories")) if "categories" in table.column_names else None

    def meet(self, docs: np.ndarray, ids: np.ndarray, categories, skip_self: bool) -> None:
        cats = _sparse(categories, self.cats[3]) if self.cats is not None else None
        _score_block(self.best, self.vectors, self.ids, docs, ids, skip_self, self.cats, cats)


def _search_cells(k: int, blocks: int, skip_self: bool, prep, names: pa.Schema):
    """Batches sorted by cell, blocks of queries before documents (``block`` = ``blocks``), to the k best of each cell's queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, held = None, {}, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                part, (qb, dg, block) = batch.slice(a, b - a), keys[a].tolist()
                if (qb, dg) != cell:
                    yield from (_emit(x.best, x.names, names) for x in held or ())
                    cell, waiting, held = (qb, dg), {}, None
                if block < blocks:
                    waiting.setdefault(block, []).append(part)
                    continue
                if held is None:
                    held, waiting = [_Block(waiting[x], k, prep) for x in waiting], {}
                for lo in range(0, part.num_rows if held else 0, DOC_ROWS):
                    some = part.slice(lo, DOC_ROWS)
                    docs, ids = prep(_matrix(some.column("vector"))), _ids(some.column("doc_id"))
                    for x in held:
                        x.meet(docs, ids, some.column("categories") if x.cats is not None else None, skip_self)
        yield from (_emit(x.best, x.names, names) for x in held or ())

    return search


def mean_vectors(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Mean vector per group; partial sums are merged map-side, so one dense buffer per group is shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(group).agg(vector_to_array(mean).alias(vector), F.count("*").alias("members"))
