"""Ordering and picking inside groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group.

    The filter on the row number lets Spark cut every map task's share of a group to k rows before the shuffle
    (WindowGroupLimit), so a group holding a third of the table costs k rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rank_results(scored: DataFrame, k: int | None = None, score: str = "score", group: Sequence[str] = ("query_id",),
                 item: str = "doc_id") -> DataFrame:
    """Rank results per query by score, ties by id."""
    order = [F.col(score).desc(), F.col(item)]
    if k is not None:
        return top_per_group(scored, group, order, k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def smallest_first(docs: DataFrame, limit: int | None = None, offset: int = 0, size: str = "total_words",
                   key: str = "document_id") -> DataFrame:
    """Work order: smallest documents first. With a limit this is a distributed top-k, not a full sort."""
    ordered = docs.orderBy(size, key)
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit; to resume open-ended work use resume_after or an anti join")
        return ordered
    return ordered.offset(offset).limit(limit)


def resume_after(docs: DataFrame, last_key, key: str = "document_id") -> DataFrame:
    """Resume behind the last finished key: a pushed-down filter in place of a growing offset."""
    return docs.filter(F.col(key) > F.lit(last_key))


def sample_by_hash(df: DataFrame, group: str, key: str, share: float = 0.1, at_least: int = 1, seed: int = 42) -> DataFrame:
    """Exactly max(floor(share * n), at_least) rows of every group, chosen by a seeded hash of the key.

    A group may hold most of the table, so it is not sorted in one window. Rows fall into 4096 hash slots per
    group; slot counts say which slots are taken whole and which single slot per group is cut, and only that
    slot's rows (about n / 4096) are ordered.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    tagged = df.withColumn("_h", digest).withColumn("_slot", F.substring("_h", 1, 3))
    counts = tagged.groupBy(group, "_slot").agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(group)
    running = by_group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    need = F.greatest(F.floor(F.sum("_n").over(by_group) * F.lit(share)), F.lit(at_least))
    plan = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .withColumn("_left", need - F.col("_before"))
        .filter(F.col("_left") > 0)
        .select(F.col(group).alias("_g"), F.col("_slot").alias("_s"), "_n", "_left")
    )
    hit = tagged.join(plan, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slot") == F.col("_s")))
    whole = hit.filter(F.col("_n") <= F.col("_left"))
    cut = hit.filter(F.col("_n") > F.col("_left"))
    order = Window.partitionBy("_g", "_slot").orderBy("_h", key)
    part = cut.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))
