"""Summaries and keywords for every document that lacks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as cp
from ..operators import extractive as ex
from ..operators import keywords as kw
from ..sources.writers import update_fields


def section_text(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents (document_id, content) whose content is that of their sections in order, a blank line between; without sections it stays."""
    ordered = F.array_sort(F.collect_list(F.struct("section_order", "content")))
    joined = sections.join(docs.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["content"]), "\n\n").alias("_joined"))
    return docs.join(joined, "document_id", "left").withColumn("content", F.coalesce("_joined", "content")).drop("_joined")


def summarise(docs: DataFrame, sections: DataFrame, idf: Column, summariser=None) -> DataFrame:
    """(document_id, summary, summary_word_count, compression_ratio, tier) of documents without a summary.

    Tier 1 keeps the text, the others extract by their recipe, the second from its sections as one text; a document
    without section rows is one section of its own. ``summariser``: a pandas UDF string -> string run on
    the extract (for instance a neural model); the default summary is the extract itself.
    """
    todo = docs.filter(F.col("summary").isNull()).withColumn("tier", tx.tier(F.col("total_words")))
    base = todo.select("document_id", "total_words", "tier", "content")
    keys = lambda t: base.filter(F.col("tier") == t)
    first = keys(1).select("document_id", F.col("content").alias("extract"))
    parts = sections.select("document_id", F.col("section_order").cast("int").alias("section_order"), "content")
    second = ex.second_tier(section_text(keys(2), parts), idf)
    held = parts.join(keys(3).select("document_id"), "document_id", "left_semi")
    alone = keys(3).join(parts.select("document_id"), "document_id", "left_anti")
    third = ex.third_tier(held.unionByName(alone.select("document_id", F.lit(0).alias("section_order"), "content")), idf)
    fourth = ex.fourth_tier(keys(4), idf)
    text = F.col("extract") if summariser is None else summariser(F.col("extract"))
    made = first.unionByName(second).unionByName(third).unionByName(fourth).select("document_id", text.alias("summary"))
    counted = made.join(base.drop("content"), "document_id").withColumn("summary_word_count", tx.word_count(F.col("summary")))
    ratio = F.round(tx.ratio(F.col("summary_word_count"), F.col("total_words")), 6)
    return counted.select("document_id", "summary", "summary_word_count", ratio.alias("compression_ratio"), "tier")


def replace_summaries(docs: DataFrame, rewritten: DataFrame) -> DataFrame:
    """New summary texts (document_id, summary) in: words and ratio are counted again."""
    fresh = rewritten.withColumn("summary_word_count", tx.word_count(F.col("summary"))).join(
        docs.select("document_id", "total_words"), "document_id")
    ratio = F.round(tx.ratio(F.col("summary_word_count"), F.col("total_words")), 6)
    made = fresh.select("document_id", "summary", "summary_word_count", ratio.alias("compression_ratio"))
    return update_fields(docs, made, "document_id", ("summary", "summary_word_count", "compression_ratio"))


def add_keywords(docs: DataFrame, keywords: DataFrame, idf: Column, text: str = "content", hash_name: str = "xxhash64") -> DataFrame:
    """Keyword table with keywords for every summarised document that had none (an anti join, no running offset)."""
    todo = cp.without_keywords(docs, keywords)
    made = kw.extract_keywords(todo, idf, text, hash_name=hash_name)
    # The anti join left only documents without keywords, so no key can clash: adding rows is the whole upsert.
    return keywords.select("document_id", "keyword", "score").unionByName(made)
