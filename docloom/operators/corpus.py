"""Joins and counts over the corpus tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import top_per_group



# -- lookups -------------------------------------------------------------------------------------------------

def with_lookups(docs: DataFrame, forms: DataFrame, bodies: DataFrame) -> DataFrame:
    """Documents with form and body names; documents without one are kept.

    The lookup tables carry no broadcast hint: their measured size decides at run time.
    """
    return docs.join(forms, "form_id", "left").join(
        bodies.withColumnRenamed("body_id", "responsible_body_id"), "responsible_body_id", "left"
    )


def linked_names(bridge: DataFrame, dim: DataFrame, key: str, name: str, alias: str) -> DataFrame:
    """(document, name) rows of one many-to-many relation, distinct."""
    return bridge.join(dim, key).select("document_id", F.col(name).alias("value")).distinct().withColumn(
        "feature", F.lit(alias)
    )


def list_features(links: Sequence[DataFrame]) -> DataFrame:
    """Several relations folded into list columns in one shuffle: one row per document.

    Replaces one query per document and relation. A document's own links are bounded by what one document holds.
    """
    long = reduce(DataFrame.unionByName, links)
    return long.groupBy("document_id", "feature").agg(F.sort_array(F.collect_set("value")).alias("names"))


def bundle(docs: DataFrame, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Documents with their list features as columns; a document without links gets empty lists."""
    empty = F.array().cast("array<string>")
    wide = features.groupBy("document_id").agg(
        *(F.max(F.when(F.col("feature") == n, F.col("names"))).alias(n) for n in names)
    )
    return docs.join(wide, "document_id", "left").withColumns({n: F.coalesce(n, empty) for n in names})


def sections_of(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of a key set of documents; order by (document_id, section_order) when showing them."""
    return sections.join(docs.select("document_id", "celex_number"), "document_id")


def keywords_of(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    return keywords.join(docs.select("document_id", "celex_number"), "document_id")


def top_keywords(keywords: DataFrame, k: int = 20) -> DataFrame:
    """Keyword list per document, best first (at most k)."""
    top = top_per_group(keywords, ["document_id"], [F.col("score").desc(), F.col("keyword")], k)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "keyword")))
    return top.groupBy("document_id").agg(F.transform(ordered, lambda x: x["keyword"]).alias("keywords"))


def without_keywords(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Documents with a summary and no keywords yet."""
    return docs.filter(F.col("summary").isNotNull()).join(keywords.select("document_id"), "document_id", "left_anti")


def with_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    return docs.join(sections.select("document_id"), "document_id", "left_semi")


def without_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    return docs.join(sections.select("document_id"), "document_id", "left_anti")


def unseen(batch: DataFrame, seen: DataFrame, key: str = "celex_number") -> DataFrame:
    """Rows whose key has not been processed before."""
    return batch.join(seen.select(key), key, "left_anti")


def titles(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Title per key, ``Document <key>`` where missing."""
    named = docs.select("celex_number", F.nullif(F.trim("title"), F.lit("")).alias("_title"))
    return keys.join(named, "celex_number", "left").select(
        *keys.columns, F.coalesce("_title", F.concat(F.lit("Document "), F.col("celex_number"))).alias("title")
    )


def with_dates(results: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results with their document's date: one join for all results."""
    return results.join(docs.select(F.col("document_id").alias(key), "date_of_document"), key, "left")


def by_key(docs: DataFrame, keys: DataFrame, include_summary: bool = False) -> DataFrame:
    """Documents by natural key, with or without the summary fields."""
    extra = ["summary", "summary_word_count", "compression_ratio"]
    cols = [c for c in docs.columns if include_summary or c not in extra]
    return docs.select(*cols).join(keys.select("celex_number"), "celex_number", "left_semi")


def outlier_details(docs: DataFrame, outliers: DataFrame) -> DataFrame:
    return docs.join(outliers.select("document_id"), "document_id", "left_semi")


def resolve_history(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """History ids to stored vectors, trying other spellings in order.

    Spellings: as given, upper case, without the ``CELEX:`` prefix, bare key characters. Each vector row is hit by
    an equality join on one spelling column; the lowest-numbered spelling that hits wins.
    """
    given = F.trim("history_id")
    options = F.array(
        given, F.upper(given), F.regexp_replace(F.upper(given), "^CELEX:", ""),
        F.regexp_replace(F.upper(given), "[^0-9A-Z]", ""),
    )
    tried = history.select("user_id", "history_id", F.posexplode(F.array_distinct(options)).alias("_try", "doc_id"))
    found = tried.join(vectors.select("doc_id"), "doc_id")
    return found.groupBy("user_id", "history_id").agg(F.min_by("doc_id", "_try").alias("doc_id"))


# -- duplicates ----------------------------------------------------------------------------------------------

def duplicate_keys(stored: DataFrame, key: str = "celex_number", path: str = "file_path") -> DataFrame:
    """Every stored copy of a key held more than once: (key, path, copies).

    Copies are rows, not a list, so a key with a third of the store stays spread; the join back is a plain
    equality join the runtime planner may split.
    """
    counts = stored.groupBy(key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return stored.select(key, path).join(counts, key)


def keep_earliest(stored: DataFrame, key: str = "celex_number", date: str = "stored_on",
                  path: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Earliest-dated copy per key, and the removed copies.

    The pick is a map-side-combined minimum; the removed rows come from an anti join on the unique path.
    """
    first = F.min(F.struct(F.col(date), F.col(path))).alias("_first")
    winners = stored.groupBy(key).agg(first).select(F.col(f"_first.{path}").alias(path))
    return stored.join(winners, path, "left_semi"), stored.join(winners, path, "left_anti")


# -- counts --------------------------------------------------------------------------------------------------

def total_words(sections: DataFrame) -> DataFrame:
    return sections.groupBy("document_id").agg(F.sum("word_count").alias("total_words"))


def set_total_words(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents with total_words from their sections; 0 without any."""
    return docs.drop("total_words").join(total_words(sections), "document_id", "left").fillna(0, ["total_words"])


def tier_counts(docs: DataFrame, words: str = "total_words") -> DataFrame:
    """Documents per tier with share and word range; the share window runs over the four tier rows."""
    per_tier = docs.groupBy(tx.tier(F.col(words)).alias("tier")).agg(
        F.count("*").alias("documents"), F.min(words).alias("min_words"), F.max(words).alias("max_words")
    )
    share = F.round(F.col("documents") * 100.0 / F.sum("documents").over(Window.partitionBy()), 6)
    return per_tier.withColumn("share", share)


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, as rows: one pass over the table."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))
    return counted.select("_n", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.nulls", F.round(F.col("p.nulls") * 100.0 / F.col("_n"), 6).alias("null_pct")
    )


def missing_share(df: DataFrame, column: str, group: str) -> DataFrame:
    share = F.round(F.avg(F.col(column).isNull().cast("double")), 6)
    return df.groupBy(group).agg(share.alias("missing_share")).orderBy(F.col("missing_share").desc(), group)


def value_counts(df: DataFrame, column: str, limit: int | None = 20, count: str = "n") -> DataFrame:
    """Counts per value, the null group included; most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias(count))
    return counts.orderBy(F.col(count).desc(), F.col(column).asc_nulls_first()).limit(limit) if limit else counts


def documents_per_link(bridge: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Documents per linked value. Counted by id first, so the name join sees one row per id."""
    counts = bridge.groupBy(key).agg(F.count("*").alias("documents"))
    return counts.join(dim, key).groupBy(name).agg(F.sum("documents").alias("documents"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts pivoted to a column for each of ``values``, missing cells 0. For values not known beforehand: ``cross_counts``."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0, [str(v) for v in values])


def cross_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """The same counts as rows (row value, column value, n) for any number of values."""
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def documents_per_month(docs: DataFrame, date: str = "date_of_document") -> DataFrame:
    dated = docs.filter(F.col(date).isNotNull())
    return dated.groupBy(F.trunc(date, "MM").alias("month_start")).agg(F.count("*").alias("documents"))


def documents_per_calendar_month(docs: DataFrame, date: str = "date_of_document") -> DataFrame:
    dated = docs.filter(F.col(date).isNotNull())
    return dated.groupBy(F.month(date).alias("month")).agg(F.count("*").alias("documents"))


def author_pairs(bridge: DataFrame, item: str = "author_id", limit: int | None = None) -> DataFrame:
    """Pairs of authors sharing documents, with the number of shared documents.

    The pairs are the result, so they are enumerated, but by an equality join the runtime planner can split for a
    document with very many authors, and counted map-side before the second shuffle.
    """
    links = bridge.select("document_id", item).distinct()
    left = links.select("document_id", F.col(item).alias("first"))
    right = links.select("document_id", F.col(item).alias("second"))
    counts = (
        left.join(right, "document_id").filter(F.col("first") < F.col("second"))
        .groupBy("first", "second").agg(F.count("*").alias("documents"))
    )
    return counts.orderBy(F.col("documents").desc(), "first", "second").limit(limit) if limit else counts


def section_texts(sections: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Section text joined per document in section order (a document's text is one cell in the source)."""
    ordered = F.sort_array(F.collect_list(F.struct("section_order", "content")))
    return sections.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["content"]), separator).alias("content")
    )
