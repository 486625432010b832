"""Exact top-k by categories alone, through posting lists of feature values.

Rows with the same weighted features score alike, so classes of equal features meet instead of rows: a class of queries
meets the classes of documents that share a value with it, and of a class only its first k documents can be results.
A value that a third of all documents hold costs as many meetings as these documents have different feature sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..session import materialise
from .ranking import top_per_group

DIGITS = 9  # scores are compared at this precision, ties broken by id


def weighted_features(features: Column, weights: Mapping[str, float], multi: Sequence[str]) -> Column:
    """The part of a map<string,array<string>> that counts, in one order: array<struct<feature,values>>.

    A feature with a list (even an empty one) is known; a single-valued one has the first value of its list.
    """
    def one(name: str) -> Column:
        values = F.try_element_at(features, F.lit(name))
        held = F.array_sort(F.array_distinct(F.array_compact(values))) if name in multi else F.slice(values, 1, 1)
        return F.when(values.isNotNull(), F.struct(F.lit(name).alias("feature"), held.alias("values")))

    return F.array_compact(F.array(*(one(n) for n in sorted(weights))))


def _classes(rows: DataFrame, key: str, name: str, weights: Mapping[str, float], multi: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(name, own): the different feature sets, numbered; and (name, key): the rows of each."""
    held = rows.select(key, weighted_features(F.col("features"), weights, multi).alias("own")).where(F.size("own") > 0)
    numbered = materialise(held.select("own").distinct().withColumn(name, F.monotonically_increasing_id()), name)
    return numbered, held.join(numbered, "own").select(name, key)


def top_k_categories(queries: DataFrame, docs: DataFrame, k: int, weights: Mapping[str, float] = sc.FEATURE_WEIGHTS,
                     multi: Sequence[str] = sc.MULTI_VALUED) -> DataFrame:
    """queries (query_id, features), docs (doc_id, features): the k documents of highest feature match for each query.

    Features are map<string,array<string>>; the score is ``scores.feature_match``. Only documents that share a value
    with the query are results. Returns (query_id, doc_id, score, rank); ties are broken by id.
    """
    asked, asking = _classes(queries, "query_id", "query_class", weights, multi)
    held, holding = _classes(docs, "doc_id", "doc_class", weights, multi)
    value = lambda df, name: df.select(name, F.explode("own").alias("x")).select(name, F.col("x.feature").alias("feature"), F.explode("x.values").alias("value"))
    met = value(asked, "query_class").join(value(held, "doc_class"), ["feature", "value"]).select("query_class", "doc_class").distinct()
    pairs = met.join(asked.withColumnRenamed("own", "_q"), "query_class").join(held.withColumnRenamed("own", "_d"), "doc_class")
    score = sc.feature_match(F.map_from_entries("_q"), F.map_from_entries("_d"), weights, multi)
    scored = pairs.select("query_class", "doc_class", F.round(score, DIGITS).alias("score")).where("score > 0")
    # Every class has a document, so the classes that are not among the k best scores have no result.
    best = scored.withColumn("_r", F.rank().over(Window.partitionBy("query_class").orderBy(F.col("score").desc()))).where(F.col("_r") <= k).drop("_r")
    first = top_per_group(holding, ["doc_class"], [F.col("doc_id")], k, "_r").drop("_r")
    lists = materialise(top_per_group(best.join(first, "doc_class"), ["query_class"], [F.col("score").desc(), F.col("doc_id")], k), "lists")
    return asking.join(lists, "query_class").select("query_id", "doc_id", "score", "rank")
