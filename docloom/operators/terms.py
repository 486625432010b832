"""Sparse text vectors over plain terms, and exact top-k search that reads the postings a result can come from.

A vector is array<struct<term,w>> of unit length; there is no dimension and no vocabulary on the driver. The search
bounds what a term can add to a score by its largest weight in any document. Sorted by these bounds, the weakest terms
of a query that together stay below a score k documents are known to reach cannot bring a document into the result
alone: their postings are only looked up for documents that the other terms found and that can still make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vc
from ..functions.text import let
from ..session import materialise
from .ranking import top_per_group

TERMS = "array<struct<term:string,w:double>>"
DIGITS = 6      # scores are compared at this precision, ties broken by id
SLACK = 2e-6    # so far a bound must stay below a score, because both are rounded


def term_idf(docs: DataFrame, toks: Column) -> tuple[DataFrame, int]:
    """(term, idf) with idf = ln((N + 1) / (df + 1)), and N. A term's rows are counted before they are shuffled."""
    n = docs.count()
    present = docs.select(F.explode(F.array_distinct(toks)).alias("term"))
    return idf_of(present.groupBy("term").agg(F.count("*").alias("df")), n), n


def idf_of(frequencies: DataFrame, n: int) -> DataFrame:
    """(term, idf) of document frequencies (term, df) among n documents."""
    return frequencies.select("term", F.ln((F.lit(n) + 1) / (F.col("df") + 1)).alias("idf"))


def sparse_vectors(df: DataFrame, key: str, toks: Column, idf: DataFrame, n: int) -> DataFrame:
    """(key, terms): unit tf-idf vectors; terms of no fitted document weigh as the rarest. ``key`` is unique.

    Rows without tokens get an empty vector.
    """
    counted = df.select(key, F.explode_outer(tx.term_counts(toks)).alias("c")).select(key, F.col("c.term").alias("term"), F.col("c.tf").alias("tf"))
    weight = F.col("tf") * F.coalesce("idf", F.ln(F.lit(float(n)) + 1))
    rows = counted.join(idf, "term", "left").withColumn("w", weight)
    pairs = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "w")))
    held = rows.groupBy(key).agg(F.array_sort(pairs).alias("_t"))
    return held.select(key, unit_terms(F.col("_t")).alias("terms"))


def unit_terms(terms: Column) -> Column:
    """Terms scaled to length 1; without any weight they stay as they are."""
    length = lambda t: F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return let(terms, lambda t: let(length(t), lambda n: F.when(
        n > 0, F.transform(t, lambda x: F.struct(x["term"].alias("term"), (x["w"] / n).alias("w")))).otherwise(t)))


def blend_terms(text: Column, keywords: Column, n: Column, fixed_summary_weight: float | None = None) -> Column:
    """Text and keyword vectors as one, as vectors.blend does for dense ones; a missing (null) side leaves the other."""
    wk = vc.keyword_weight(n, fixed_summary_weight)

    def part(terms: Column, w: Column) -> Column:
        return F.map_from_entries(F.transform(terms, lambda x: F.struct(x["term"], x["w"] * w)))

    def mixed(a: Column, b: Column) -> Column:
        names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
        own = lambda m, t: F.coalesce(F.try_element_at(m, t), F.lit(0.0))
        return F.transform(names, lambda t: F.struct(t.alias("term"), (own(a, t) + own(b, t)).alias("w")))

    both = let(part(text, F.lit(1.0) - wk), lambda a: let(part(keywords, wk), lambda b: mixed(a, b)))
    return F.when(keywords.isNull(), text).when(text.isNull(), keywords).otherwise(unit_terms(both))


def postings(vectors: DataFrame) -> DataFrame:
    """(term, doc_id, w) rows of vectors (doc_id, terms)."""
    return vectors.select("doc_id", F.explode("terms").alias("x")).select(F.col("x.term").alias("term"), "doc_id", F.col("x.w").alias("w"))


def top_k_terms(queries: DataFrame, held: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """queries (query_id, terms), held: postings (term, doc_id, w): the k documents of highest inner product for each query.

    Returns (query_id, doc_id, score, rank), scores rounded to 6 places and ties broken by id. Only documents that share
    a term with the query are results. Weights are not negative. The postings of the queries' terms are written once.
    """
    asked = materialise(queries.select("query_id", F.explode("terms").alias("x")).select("query_id", F.col("x.term").alias("term"), F.col("x.w").alias("q")).where("q > 0"), "asked")
    held = materialise(held.join(asked.select("term").distinct(), "term", "left_semi").where("w > 0"), "postings")
    most = held.groupBy("term").agg(F.max("w").alias("most"))
    # k documents hold the term with at least this weight (one more, where the query's own document does not count).
    sure = top_per_group(held.select("term", "w"), ["term"], [F.col("w").desc()], k + skip_self, "nth").where(F.col("nth") == k + skip_self).select("term", F.col("w").alias("sure"))
    by_query = Window.partitionBy("query_id")
    weakest_first = by_query.orderBy("reach", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = (asked.join(most, "term").join(sure, "term", "left")
               .withColumn("reach", F.col("q") * F.col("most"))
               .withColumn("floor", F.coalesce(F.max(F.col("q") * F.col("sure")).over(by_query), F.lit(0.0)))
               .withColumn("weak", F.sum("reach").over(weakest_first) < F.col("floor") - SLACK))
    bounded = materialise(bounded.select("query_id", "term", "q", "reach", "floor", "weak"), "bounds")

    found = bounded.where(~F.col("weak")).join(held, "term")
    if skip_self:
        found = found.where(F.col("query_id") != F.col("doc_id"))
    part = materialise(found.groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("part")), "candidates")
    reached = top_per_group(part, ["query_id"], [F.col("part").desc()], k, "nth").where(F.col("nth") == k).select("query_id", F.col("part").alias("reached"))
    rest = bounded.groupBy("query_id").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(F.col("weak"), F.col("reach"))), F.lit(0.0)).alias("rest"))
    limits = rest.join(reached, "query_id", "left").select("query_id", "rest", F.greatest("floor", F.coalesce("reached", F.lit(0.0))).alias("floor"))
    limits = materialise(limits, "limits")
    open_ = part.join(limits, "query_id").where(F.col("part") + F.col("rest") >= F.col("floor") - SLACK).select("query_id", "doc_id", "part")
    open_ = materialise(open_, "open")
    looked_up = open_.join(bounded.where("weak").select("query_id", "term", "q"), "query_id").join(held, ["term", "doc_id"])
    more = looked_up.groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("more"))
    score = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), DIGITS)
    scored = open_.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", score.alias("score"))
    return top_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
