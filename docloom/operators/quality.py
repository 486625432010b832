"""Quality of summaries: overlap scores, keyword retention, tier means."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import let


def _f_measure(shared: Column, a: Column, b: Column) -> Column:
    """Harmonic mean of shared/a and shared/b; 0 when nothing is shared."""
    return F.coalesce(F.try_divide(2.0 * shared, (a + b).cast("double")), F.lit(0.0))


def rouge_n(summary: Column, text: Column, n: int) -> Column:
    """F score of the distinct word n-grams two texts share. Whole texts, computed inside the row."""
    grams = lambda c: F.array_distinct(tx.ngrams(tx.words(c), n))
    return let(grams(summary), lambda a: let(grams(text), lambda b: F.round(
        _f_measure(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)), 6)))


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit rows: one pass over b with whole-row integer steps."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def rouge_l(df: DataFrame, summary: str, text: str, key: str = "document_id", out: str = "rouge_l") -> DataFrame:
    """(key, F score of the longest common word subsequence), Arrow-batched."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for s, t in zip(batch[summary], batch[text]):
                a, b = (s or "").split(), (t or "").split()
                common = _lcs(a, b) if a and b else 0
                scores.append(round(2.0 * common / (len(a) + len(b)), 6) if common else 0.0)
            yield pd.DataFrame({key: batch[key], out: scores})

    return df.select(key, summary, text).mapInPandas(run, f"{key} {kind}, {out} double")


def keyword_retention(summary: Column, keywords: Column) -> Column:
    """Share of the keyword words found in the summary; 0 without keywords."""
    return F.round(F.coalesce(F.try_divide(
        F.size(F.array_intersect(F.array_distinct(keywords), tx.tokens(summary))).cast("double"),
        F.size(F.array_distinct(keywords)).cast("double")), F.lit(0.0)), 6)


def quality_table(df: DataFrame, text: str = "content", summary: str = "summary", keywords: str = "keywords") -> DataFrame:
    """Per document: ratio, overlap scores, retention, lengths. ``keywords`` is a comma-separated string."""
    clean = df.withColumns({"_t": tx.squeeze(F.col(text)), "_s": tx.squeeze(F.col(summary)), "_k": tx.keyword_words(F.col(keywords))})
    scored = clean.select(
        "document_id", "tier", "_s", "_t",
        F.round(tx.ratio(F.length("_s"), F.length("_t")), 6).alias("compression_ratio"),
        rouge_n(F.col("_s"), F.col("_t"), 1).alias("rouge_1"), rouge_n(F.col("_s"), F.col("_t"), 2).alias("rouge_2"),
        keyword_retention(F.col("_s"), F.col("_k")).alias("keyword_retention"),
        F.length("_t").alias("original_length"), F.length("_s").alias("summary_length"), F.size("_k").alias("keyword_count"),
    )
    return scored.drop("_s", "_t")


def tier_means(quality: DataFrame) -> DataFrame:
    names = [c for c in quality.columns if c not in ("document_id", "tier")]
    return quality.groupBy("tier").agg(
        F.count("*").alias("documents"), *(F.round(F.avg(c), 6).alias(c) for c in names)
    )
