"""Ratings: statistics and the boost they give to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from .ranking import rank_results


def document_ratings(feedback: DataFrame) -> DataFrame:
    """Per document: count, mean and the 1..5 distribution."""
    return feedback.groupBy("document_id").agg(
        F.count("*").alias("ratings"),
        F.round(F.avg("rating"), 6).alias("avg_rating"),
        *(F.count_if(F.col("rating") == r).alias(f"rated_{r}") for r in range(1, 6)),
    )


def user_statistics(feedback: DataFrame, liked: int = 4) -> DataFrame:
    """Per user: count, mean, and how many distinct documents were rated at least ``liked``.

    Reduced to (user, document) first: a user with a third of all events is combined before the second step.
    """
    per_pair = feedback.groupBy("user_id", "document_id").agg(
        F.count("*").alias("n"), F.sum("rating").alias("s"), F.max("rating").alias("best")
    )
    return per_pair.groupBy("user_id").agg(
        F.sum("n").alias("ratings"),
        F.round(F.sum("s") / F.sum("n"), 6).alias("avg_rating"),
        F.count_if(F.col("best") >= liked).alias("liked_documents"),
    )


def liked_documents(feedback: DataFrame, liked: int = 4) -> DataFrame:
    """(user, document) rows rated at least ``liked``."""
    return feedback.filter(F.col("rating") >= liked).select("user_id", "document_id").distinct()


def overall_statistics(feedback: DataFrame) -> DataFrame:
    """Totals over all feedback, with distinct users and documents."""
    return feedback.agg(
        F.count("*").alias("ratings"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("document_id").alias("documents"),
        F.round(F.avg("rating"), 6).alias("avg_rating"),
        *(F.count_if(F.col("rating") == r).alias(f"rated_{r}") for r in range(1, 6)),
    )


def boost(results: DataFrame, feedback: DataFrame, factor: float = 0.2, per_user: bool = False) -> DataFrame:
    """Scores raised by the average rating, global or of the asking user (``user_id`` on the results); re-ranked."""
    keys = ["document_id", "user_id"] if per_user else ["document_id"]
    rated = feedback.groupBy(*keys).agg(F.avg("rating").alias("avg_rating")).withColumnRenamed("document_id", "doc_id")
    on = ["doc_id", "user_id"] if per_user else ["doc_id"]
    joined = results.drop("rank").join(rated, on, "left")
    scored = joined.withColumn("score", F.round(sc.feedback_boost(F.col("score"), F.col("avg_rating"), factor), 12))
    return rank_results(scored)
