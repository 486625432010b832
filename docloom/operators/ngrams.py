"""Most frequent terms and n-grams of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def term_frequencies(docs: DataFrame, toks: Column) -> DataFrame:
    """(term, n, docs) over a token array column.

    Terms are counted inside each row, so the shuffle carries one partial count per task and term, and the
    document count needs no distinct step.
    """
    rows = docs.select(F.explode(tx.term_counts(toks)).alias("t"))
    return rows.groupBy("t.term").agg(F.sum("t.tf").alias("n"), F.count("*").alias("docs"))


def top_tokens(docs: DataFrame, text: str = "content", k: int = 20) -> DataFrame:
    freq = term_frequencies(docs, tx.alphabetic_tokens(F.col(text)))
    return freq.select("term", "n").orderBy(F.col("n").desc(), "term").limit(k)


def top_ngrams(docs: DataFrame, n: int, text: str = "content", k: int = 20, min_docs: int = 2) -> DataFrame:
    """Top n-grams over words of two letters or more, stop words out, found in at least ``min_docs`` documents."""
    grams = tx.ngrams(tx.tokens(F.col(text), min_len=2), n)
    freq = term_frequencies(docs, grams).filter(F.col("docs") >= min_docs)
    return freq.orderBy(F.col("n").desc(), "term").limit(k)
