"""Summaries and comparisons of recommendation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(results: DataFrame) -> DataFrame:
    """Per query: number, mean and best score, distinct types, first and last year."""
    return results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("avg_score"), F.max("score").alias("max_score"),
        F.count_distinct("document_type").alias("types"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def subject_counts(results: DataFrame, subjects: str = "subjects", k: int = 10) -> DataFrame:
    counts = results.select(F.explode(subjects).alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "subject").limit(k)


def year_histogram(results: DataFrame, this_year: int, year: str = "year", first: int = 1950, bins: int = 20) -> DataFrame:
    """Even-width bins over the years present, at most ``bins`` of them; years outside first..this_year are left out."""
    years = results.filter(F.col(year).between(first, this_year)).groupBy(F.col(year).alias("y")).agg(F.count("*").alias("n"))
    span = years.agg(
        F.struct(F.min("y").alias("lo"), F.max("y").alias("hi"), F.least(F.count("*"), F.lit(bins)).alias("k")).alias("s")
    ).scalar()
    tagged = years.withColumn("s", span)
    width = (F.col("s.hi") - F.col("s.lo") + 1) / F.col("s.k")
    bin_no = F.floor((F.col("y") - F.col("s.lo")) / width).cast("int")
    return tagged.groupBy(bin_no.alias("bin")).agg(
        F.min("y").alias("from_year"), F.max("y").alias("to_year"), F.sum("n").alias("n")
    )


def overlap(results: DataFrame, pairs: Sequence[tuple[str, str]], config: str = "config") -> DataFrame:
    """Shared documents and Jaccard of named pairs of configurations, per query.

    Result lists hold at most k documents, so the sets per (query, configuration) are small. Only the pairs asked
    for are built.
    """
    sets = results.groupBy("query_id", config).agg(F.collect_set("doc_id").alias("docs"))
    side = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    tagged = sets.withColumn("p", F.explode(side)).filter((F.col(config) == F.col("p.a")) | (F.col(config) == F.col("p.b")))
    both = tagged.groupBy("query_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.max(F.when(F.col(config) == F.col("p.a"), F.col("docs"))).alias("left"),
        F.max(F.when(F.col(config) == F.col("p.b"), F.col("docs"))).alias("right"),
    )
    shared = F.size(F.array_intersect("left", "right"))
    return both.select(
        "query_id", "a", "b", shared.cast("long").alias("shared"),
        F.round(shared / F.size(F.array_union("left", "right")), 6).alias("jaccard"),
    )
