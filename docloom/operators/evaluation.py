"""Ranking quality: precision, recall, NDCG, MAP, diversity, coverage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import top_per_group

K_VALUES = (5, 10, 20)
COLUMNS = 4096  # documents of a cell multiplied at a time
METRICS = ("precision", "recall", "ndcg", "map")


def judged(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """Results with their judgement, 0 where there is none. Judgements: (query_id, doc_id, rel)."""
    return results.join(judgements.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").fillna(0.0, ["rel"])


def ideal_gains(judgements: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per query: number of relevant documents and the ideal discounted gain at each k.

    Only the best max(k) judgements of a query take part, cut before the shuffle.
    """
    positive = judgements.filter(F.col("rel") > 0)
    counts = positive.groupBy("query_id").agg(F.count("*").alias("relevant"))
    best = top_per_group(positive, ["query_id"], [F.col("rel").desc()], max(ks), "pos")
    gain = F.col("rel") / F.log2(F.col("pos") + 1.0)
    ideal = best.groupBy("query_id").agg(*(F.sum(F.when(F.col("pos") <= k, gain)).alias(f"ideal_{k}") for k in ks))
    return counts.join(ideal, "query_id")


def query_metrics(results: DataFrame, judgements: DataFrame, ks: Sequence[int] = K_VALUES,
                  groups: Sequence[str] = ()) -> DataFrame:
    """All metrics at all k per query (and group, e.g. configuration), from judgement rows (query_id, doc_id, rel)."""
    return metrics_of(judged(results, judgements), ideal_gains(judgements, ks), ks, groups)


def class_metrics(results: DataFrame, classes: DataFrame, ks: Sequence[int] = K_VALUES,
                  groups: Sequence[str] = ()) -> DataFrame:
    """The same metrics where documents are relevant to a query document of their own class (doc_id, label).

    Judgements would be all pairs inside a class, so they are never written out: a result is judged by comparing two
    labels, and the ideal follows from the class size.
    """
    own = classes.select(F.col("doc_id").alias("query_id"), F.col("label").alias("_q"))
    rows = results.join(own, "query_id").join(classes.select("doc_id", F.col("label").alias("_d")), "doc_id")
    rows = rows.withColumn("rel", (F.col("_q") == F.col("_d")).cast("double")).drop("_d", "_q")
    sizes = classes.groupBy(F.col("label").alias("_q")).agg((F.count("*") - 1).alias("relevant"))

    def ideal(k: int) -> Column:
        places = F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int"))
        return F.when(F.col("relevant") > 0, F.aggregate(places, F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0)))

    perfect = own.join(sizes, "_q").select("query_id", "relevant", *(ideal(k).alias(f"ideal_{k}") for k in ks))
    return metrics_of(rows, perfect, ks, groups)


def metrics_of(rows: DataFrame, ideal: DataFrame, ks: Sequence[int] = K_VALUES, groups: Sequence[str] = ()) -> DataFrame:
    """All metrics at all k in one pass over judged, ranked rows.

    precision divides by the number returned up to k; recall by the relevant; NDCG by the ideal gain; MAP by
    min(relevant, k). Queries without judgements give 0.
    """
    keys = [*groups, "query_id"]
    hit = (F.col("rel") > 0).cast("int")
    rows = rows.withColumn(
        "hits", F.sum(hit).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    )
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.count_if(inside).alias(f"n_{k}"),
            F.sum(F.when(inside, hit).otherwise(0)).alias(f"hits_{k}"),
            F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"gain_{k}"),
            F.sum(F.when(inside & (F.col("rel") > 0), F.col("hits") / F.col("rank")).otherwise(0.0)).alias(f"ap_{k}"),
        ]
    per_query = rows.groupBy(*keys).agg(*aggs).join(ideal, "query_id", "left")

    def over(top: str, bottom: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(top).cast("double"), bottom.cast("double")), F.lit(0.0)), 6)

    cols = []
    for k in ks:
        cols += [
            over(f"hits_{k}", F.col(f"n_{k}")).alias(f"precision_{k}"),
            over(f"hits_{k}", F.col("relevant")).alias(f"recall_{k}"),
            over(f"gain_{k}", F.col(f"ideal_{k}")).alias(f"ndcg_{k}"),
            over(f"ap_{k}", F.least(F.col("relevant"), F.lit(k))).alias(f"map_{k}"),
        ]
    return per_query.select(*keys, *cols)


def mean_metrics(per_query: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean over queries of every metric column."""
    names = [c for c in per_query.columns if c.split("_")[0] in METRICS]
    return per_query.groupBy(*groups).agg(*(F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(c) for c in names))


def mean_pairwise_cosine(results: DataFrame, vectors: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Mean cosine over all pairs of a query's first k documents, without forming pairs.

    For unit vectors the pair sum is (|sum u|^2 - sum |u|^2) / 2, so one merged vector per query is enough.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from ..functions import vectors as vc

    keys = [*groups, "query_id"]
    u = vectors.select("doc_id", vc.unit(F.col("vector").cast("array<double>")).alias("u"))
    rows = results.filter(F.col("rank") <= k).select(*keys, "doc_id").join(u, "doc_id")
    merged = rows.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("m"), F.count("*").alias("n"),
        F.sum(vc.dot(F.col("u"), F.col("u"))).alias("own"),
    )
    pair_sum = vc.dot(F.col("m"), F.col("m")) * F.col("n") * F.col("n") - F.col("own")
    return merged.select(*keys, "n", F.try_divide(pair_sum, (F.col("n") * (F.col("n") - 1)).cast("double")).alias("mean_cosine"))


def diversity(results: DataFrame, vectors: DataFrame, k: int, groups: Sequence[str] = (), single: float = 1.0) -> DataFrame:
    """1 - mean pairwise cosine of the first k; ``single`` where a query has one vector or none."""
    m = mean_pairwise_cosine(results, vectors, k, groups)
    value = F.round(F.coalesce(F.lit(1.0) - F.col("mean_cosine"), F.lit(single)) + 0.0, 6)
    keys = [*groups, "query_id"]
    base = results.select(*keys).distinct()
    return base.join(m, keys, "left").select(*keys, value.alias("diversity"))


def categorical_diversity(results: DataFrame, rows: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values over values per feature of the first k documents, and the mean of the positive ones.

    ``rows``: (doc_id, feature, value). Lists of one document or none count 0, as do features without values.
    """
    keys = [*groups, "query_id"]
    top = results.filter(F.col("rank") <= k).select(*keys, "doc_id")
    size = top.groupBy(*keys).agg(F.count("*").alias("docs"))
    per_feature = top.join(rows, "doc_id").groupBy(*keys, "feature").agg(
        (F.count_distinct("value") / F.count("*")).alias("d")
    )
    return per_feature.join(size, keys).filter(F.col("docs") > 1).groupBy(*keys).agg(
        F.round(F.avg(F.when(F.col("d") > 0, F.col("d"))), 6).alias("categorical_diversity"),
        F.count("*").alias("features"),
    )


def value_counts(results: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """How often each feature value occurs among the first k documents of all queries."""
    top = results.filter(F.col("rank") <= k).select("query_id", "doc_id")
    return top.join(rows, "doc_id").groupBy("feature", "value").agg(F.count("*").alias("n"))


def coverage(results: DataFrame) -> DataFrame:
    """Recommendations in total, distinct documents, and their ratio."""
    return results.agg(
        F.count("*").alias("total"), F.count_distinct("doc_id").alias("unique_documents"),
        F.round(F.count_distinct("doc_id") / F.count("*"), 6).alias("uniqueness_ratio"),
    )


def industry_coverage(results: DataFrame, industry: Column) -> DataFrame:
    """Clients, distinct documents and documents per client by industry."""
    tagged = results.withColumn("industry", industry)
    clients = tagged.groupBy("industry").agg(F.count_distinct("query_id").alias("clients"))
    docs = tagged.groupBy("industry", "doc_id").agg(F.lit(1).alias("one")).groupBy("industry").agg(F.count("*").alias("unique_documents"))
    return clients.join(docs, "industry").select(
        "industry", "clients", "unique_documents", F.round(F.col("unique_documents") / F.col("clients"), 6).alias("documents_per_client")
    )


def mean_list_jaccard(results: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Mean Jaccard of the result lists over all pairs of clients.

    Pairs are never rows, and only those that share a document are looked at: the others add nothing. Equal lists are
    one list with its number of clients. A document's lists meet in one cell, a pair of them counts at the smallest
    document that both hold, and only the sum leaves. Lists of a document with more than ``block_rows`` of them are
    dealt into blocks, whose pairs are cells of their own. The distinct lists are written, so results are computed once.
    """
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    kinds = materialise(lists.groupBy("docs").agg(F.count("*").cast("double").alias("n")), "lists")
    n = F.col("n")
    equal = F.sum(F.when(F.size("docs") > 0, n * (n - 1) / 2))
    totals = kinds.agg(F.sum("n").alias("clients"), F.coalesce(equal, F.lit(0.0)).alias("equal"))
    held = kinds.select(F.explode("docs").alias("doc"), "docs", "n")
    dealt = held.groupBy("doc").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    homes = held.join(dealt, "doc", "left").select("doc", "docs", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("docs"), blocks).cast("int").alias("home"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = homes.select("doc", "home", "docs", "n", other.alias("other")).select("doc", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), "home", "docs", "n")
    shared = cells.repartition("doc", "a", "b").sortWithinPartitions("doc", "a", "b").mapInArrow(_overlap_cells, "total double")
    both = totals.crossJoin(shared.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total")))
    clients = F.col("clients")
    mean = F.try_divide(F.col("total") + F.col("equal"), clients * (clients - 1) / 2)
    return both.select(F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("average_overlap"))


def _overlap_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc, a, b, home, docs, n) sorted by cell to sums of n * n * Jaccard over the pairs counted there."""
    cell, parts, total = None, [], 0.0
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            key = tuple(c[lo] for c in columns)
            if key != cell:
                total += _overlap(cell, parts)
                cell, parts = key, []
            parts.append(batch.slice(lo, hi - lo))
    yield pa.RecordBatch.from_arrays([pa.array([total + _overlap(cell, parts)], pa.float64())], ["total"])


def _overlap(cell: tuple | None, parts: list[pa.RecordBatch]) -> float:
    if sum(p.num_rows for p in parts) < 2:
        return 0.0
    doc, a, b = cell
    table = pa.Table.from_batches(parts)
    lists = table.column("docs").combine_chunks()
    home, n = table.column("home").to_numpy(), table.column("n").to_numpy()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values, code, count = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), size)
    before = int(np.searchsorted(values, doc))  # documents smaller than the cell's
    left, right = np.flatnonzero(home == a), np.flatnonzero(home == b)
    place = [np.full(len(lists), -1) for _ in range(2)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    wanted = np.flatnonzero(count > 1)  # others are in one list alone

    def met(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(left), len(right)))
        for lo in range(0, len(columns), COLUMNS):
            to = np.full(len(values), -1)
            to[columns[lo:lo + COLUMNS]] = np.arange(len(columns[lo:lo + COLUMNS]))
            sides = []
            for at, rows in zip(place, (left, right)):
                m = np.zeros((len(rows), len(columns[lo:lo + COLUMNS])), np.float32)
                fit = (to[code] >= 0) & (at[row] >= 0)
                m[at[row[fit]], to[code[fit]]] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
        return out

    earlier = met(wanted[wanted < before])
    both = earlier + met(wanted[wanted >= before])
    j = np.where(earlier == 0, both / (size[left][:, None] + size[right][None, :] - both), 0.0) * n[left][:, None] * n[right][None, :]
    return float(j.sum() - np.trace(j)) / 2 if a == b else float(j.sum())
