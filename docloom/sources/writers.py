"""Sinks: partitioned stores, idempotent upserts, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as ky


def store_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write documents as a year/month/journal tree.

    A journal day may hold a third of all documents: the rebalance hint gathers rows by folder, and the
    runtime planner splits a folder that is too large for one task.
    """
    (
        with_store_columns(docs)
        .hint("rebalance", "year", "month", "journal_id")
        .write.mode(mode)
        .partitionBy("year", "month", "journal_id")
        .option("maxRecordsPerFile", 200_000)
        .parquet(path)
    )


def with_store_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "year": F.year("journal_date"),
            "month": F.month("journal_date"),
            "journal_id": F.date_format("journal_date", "yyyyMMdd"),
        }
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key by ``order``: a map-side-combined aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target with updates laid over it by key, last update winning; running it twice changes nothing.

    ``order`` names update columns that rank repeated updates of one key (its remaining columns break ties). The target holds a key once, so it only
    loses the updated keys (anti join: with few updates the target is not shuffled at all) and gains the new rows.
    The updates are read twice; write costly ones first (session.materialise).
    """
    rest = [c for c in updates.columns if c not in keys and c not in order]
    comparable = [c for c in rest if "map<" not in updates.schema[c].dataType.simpleString()]
    newest = latest(updates, keys, [*order, *comparable])
    kept = target.join(newest.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(newest.select(*(c for c in newest.columns if c in target.columns)), allowMissingColumns=True)


def update_fields(target: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Replace the given fields by key where an update holds a value; other rows and fields stay.

    Of several updates of a key the last by ``order`` counts (ties, and updates without an order, by their values), so
    the target keeps its rows.
    """
    newest = latest(updates.select(key, *dict.fromkeys([*order, *fields])), [key], [*order, *fields])
    fresh = newest.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns]
    return target.join(fresh, key, "left").select(*kept)


def replace_table(df: DataFrame, path: str) -> None:
    """Clear and rebuild a table."""
    df.write.mode("overwrite").parquet(path)


def save_profiles(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Profile upsert: new values win, the first ``created_at`` is kept, ``updated_at`` moves.

    Of several updates of one user the last by ``updated_at`` counts.
    """
    c, u = current.alias("c"), latest(updates, ["user_id"], ["updated_at"]).alias("u")
    payload = [x for x in current.columns if x not in ("user_id", "created_at", "updated_at")]
    return c.join(u, "user_id", "full_outer").select(
        "user_id",
        *(F.coalesce(f"u.{x}", f"c.{x}").alias(x) for x in payload),
        F.coalesce("c.created_at", "u.updated_at").alias("created_at"),
        F.coalesce("u.updated_at", "c.updated_at").alias("updated_at"),
    )


def apply_profile_edits(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Fold edit rows ``(user_id, seq, op, text, preferences)`` into profiles.

    ``set_text`` and ``set_preferences``: the last one wins. ``add_history``: the id joins the list if absent.
    """
    folded = edits.groupBy("user_id").agg(
        F.max_by(F.when(F.col("op") == "set_text", F.col("text")), F.when(F.col("op") == "set_text", F.col("seq"))).alias("_text"),
        F.max_by(
            F.when(F.col("op") == "set_preferences", F.col("preferences")),
            F.when(F.col("op") == "set_preferences", F.col("seq")),
        ).alias("_pref"),
    )
    added = (
        edits.filter(F.col("op") == "add_history")
        .groupBy("user_id", "text").agg(F.min("seq").alias("seq"))
        .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_added"))
        .select("user_id", F.transform("_added", lambda e: e["text"]).alias("_added"))
    )
    empty = F.array().cast("array<string>")
    return (
        profiles.join(folded, "user_id", "full_outer")
        .join(added, "user_id", "full_outer")
        .select(
            "user_id",
            F.coalesce("_text", "expert_description").alias("expert_description"),
            F.array_union(F.coalesce("historical_documents", empty), F.coalesce("_added", empty)).alias("historical_documents"),
            F.coalesce("_pref", "preferences").alias("preferences"),
        )
    )


def profile_json(profiles: DataFrame) -> DataFrame:
    """Profiles in their nested JSON layout, one string per user."""
    body = F.struct(
        "user_id",
        F.struct(
            F.struct(F.col("expert_description").alias("description")).alias("expert_profile"),
            "historical_documents",
            F.col("preferences").alias("categorical_preferences"),
        ).alias("profile"),
    )
    return profiles.select("user_id", F.to_json(body).alias("json"))


def result_table(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Export view of results: rank, title, score, key, type and address."""
    lean = docs.select(F.col("document_id").alias("doc_id"), "celex_number", "title")
    return results.join(lean, "doc_id", "left").select(
        "query_id", "rank",
        ky.default_title(F.col("title"), F.col("celex_number")).alias("title"),
        "score", "celex_number",
        ky.document_type(F.col("celex_number")).alias("document_type"),
        ky.key_url(F.col("celex_number")).alias("url"),
    )


def write_weight_groups(weights: DataFrame, path: str) -> None:
    """Rows (group, name, weight) as one JSON document ``{group: {name: weight}}``, as readers.read_weight_groups reads it."""
    members = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "weight"))))
    held = weights.groupBy("group").agg(members.alias("members"))
    groups = F.map_from_entries(F.collect_list(F.struct("group", "members")))
    held.agg(F.to_json(groups).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, so that texts with quotes, commas and line breaks come back as they were."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total size of the files below a folder; only the length column is read, never the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").option("header", True).option("escape", '"').csv(path)
