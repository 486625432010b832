"""Sources: nested JSON documents, corpus tables, profiles, feedback, metric samples, weight files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from . import schemas as S


def read_raw_documents(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """JSON documents anywhere below ``path``; unreadable files and files without a key are left out."""
    raw = (
        spark.read.schema(S.RAW_DOCUMENT_DDL)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", names)
        .json(path)
    )
    return raw.withColumn("file_path", F.col("_metadata.file_path")).withColumn(
        "modified_at", F.col("_metadata.file_modification_time")
    ).filter(F.col("metadata.celex_number").isNotNull())


def load_documents(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored documents for a key set ``(year, month, journal_id, doc_id)``.

    The key columns are the partition columns of the store, so the semi join prunes partitions at run time.
    """
    return stored.join(keys, ["year", "month", "journal_id", "doc_id"], "left_semi")


def load_document(stored: DataFrame, day: str, journal_id: str, doc_id: str) -> DataFrame:
    """One stored document; partition columns are literals, so only its folder is read."""
    return stored.filter(
        (F.col("year") == int(day[:4])) & (F.col("month") == int(day[5:7]))
        & (F.col("journal_id") == journal_id) & (F.col("doc_id") == doc_id)
    )


def read_corpus_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(S.CORPUS_DDL[name]).parquet(f"{base}/{name}")


def register_corpus(spark: SparkSession, base: str) -> list[str]:
    """Register the 13 corpus tables as temporary views."""
    for name in S.CORPUS_DDL:
        read_corpus_table(spark, base, name).createOrReplaceTempView(name)
    return list(S.CORPUS_DDL)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(S.PROFILE_DDL).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return normalise_profiles(raw.withColumn("file_name", F.col("_metadata.file_name")))


def normalise_profiles(raw: DataFrame) -> DataFrame:
    """Three profile layouts (nested profile, client components, flat) as one row shape."""

    def either(field: str):
        return F.coalesce(F.col(f"profile.{field}"), F.col(f"client.profile_components.{field}"))

    stem = F.regexp_replace("file_name", r"\.json$", "")
    return raw.select(
        F.coalesce("user_id", "client.id", "id", stem).alias("user_id"),
        F.coalesce(either("expert_profile.description"), "expert_description").alias("expert_description"),
        F.coalesce(either("historical_documents"), F.array().cast("array<string>")).alias("historical_documents"),
        F.coalesce(either("categorical_preferences"), F.from_json(F.lit("{}"), S.PREFERENCES)).alias("preferences"),
        either("weights").alias("weights"),
    )


def ground_truth(profiles: DataFrame) -> DataFrame:
    """Judgements from profiles: the history is relevant, each document with score 1."""
    docs = F.array_distinct("historical_documents")
    return profiles.select(
        F.col("user_id").alias("query_id"),
        F.col("expert_description").alias("query"),
        docs.alias("relevant_docs"),
        F.map_from_arrays(docs, F.transform(docs, lambda _: F.lit(1.0))).alias("relevance"),
    )


def judgements_long(judgements: DataFrame) -> DataFrame:
    """One row per (query, relevant document)."""
    return judgements.select("query_id", F.explode("relevance").alias("doc_id", "rel"))


def judgements_from_results(results: DataFrame, n: int = 5) -> DataFrame:
    """Judgements from a recommender's own first n results; the list is at most n long per query."""
    top = results.filter(F.col("rank") <= n)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return top.groupBy("query_id").agg(ordered.alias("relevant_docs"))


def merge_judgements(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported expert judgements replace current ones per (query, document)."""
    both = current.withColumn("source", F.lit(0)).unionByName(imported.withColumn("source", F.lit(1)))
    return both.groupBy("query_id", "doc_id").agg(F.max_by("rel", "source").alias("rel"))


def read_metric_samples(spark: SparkSession, path: str) -> DataFrame:
    """``name{labels} value`` lines of metric files; the time stands in the file name."""
    lines = spark.read.option("pathGlobFilter", "*.prom").text(path).withColumn("file", F.col("_metadata.file_name"))
    return parse_metric_lines(lines)


def parse_metric_lines(lines: DataFrame) -> DataFrame:
    """(file, value) lines to (file, sampled_at, metric, labels, sample)."""
    pattern = r"^(\w+)(?:\{([^}]*)\})?\s+(\d+(?:\.\d+)?)"
    line = tx.strip(F.col("value"))
    return (
        lines.withColumn("line", line)
        .filter(~F.col("line").startswith("#") & F.col("line").rlike(pattern))
        .select(
            "file",
            F.coalesce(
                F.try_to_timestamp(F.regexp_extract("file", r"_(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss")),
                F.timestamp_seconds(F.lit(0)),
            ).alias("sampled_at"),
            F.lower(F.regexp_extract("line", pattern, 1)).alias("metric"),
            F.regexp_extract("line", pattern, 2).alias("labels"),
            F.regexp_extract("line", pattern, 3).cast("double").alias("sample"),
        )
    )


def read_export(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of an export (writers.export_csv)."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return valid_feedback(spark.read.schema(S.FEEDBACK_DDL).option("header", True).option("escape", '"').csv(path))


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """Rows with a user, a document and a rating of 1..5."""
    return feedback.filter(
        F.col("user_id").isNotNull() & F.col("document_id").isNotNull() & F.col("rating").between(1, 5)
    )


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Saved sweep results, one row per weight setting."""
    raw = spark.read.schema(S.SWEEP_DDL).option("multiLine", True).json(path)
    return flatten_sweep(raw)


def flatten_sweep(raw: DataFrame) -> DataFrame:
    return raw.select("metric", F.posexplode("all_results").alias("config_id", "r")).select(
        "metric", "config_id", F.col("r.weights").alias("weights"), F.col("r.score").alias("score"),
        F.col("r.metrics").alias("metrics"),
    )


def read_weight_groups(spark: SparkSession, path: str) -> DataFrame:
    """Weight-group JSON ``{group: {name: weight}}`` as rows (group, name, weight)."""
    text = spark.read.text(path, wholetext=True)
    groups = F.from_json("value", "map<string,map<string,double>>")
    return text.select(F.explode(groups).alias("group", "members")).select(
        "group", F.explode("members").alias("name", "weight")
    )
