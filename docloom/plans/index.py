"""Building and saving the vector table."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as ky
from ..functions import text as tx
from ..functions import vectors as vc
from ..operators import terms as tm
from ..session import materialise
from ..sources.writers import upsert
from .recommend import Settings


def infer_features(docs: DataFrame) -> DataFrame:
    """Title, type, subjects, author and form read off key, keywords and summary, plus one feature map."""
    words = F.concat_ws(" ", F.col("keywords"))
    staged = docs.withColumns({
        "title": ky.title_or_fallback(F.col("title"), F.col("summary"), F.col("celex_number")),
        "document_type": ky.document_type(F.col("celex_number")),
        "subject_matters": ky.subjects(words, F.col("summary")),
        "form": ky.form_of(F.col("summary")),
        "num_keywords": F.size("keywords"),
    })
    pairs = F.create_map(
        F.lit("document_type"), F.array("document_type"), F.lit("subject_matters"), F.col("subject_matters"),
        F.lit("authors"), F.array(F.lit("European Union")), F.lit("form"), F.array("form"),
    )
    return staged.withColumn("features", pairs)


def build_vectors(docs: DataFrame, encoder=None, fixed_summary_weight: float | None = None) -> DataFrame:
    """Vector rows (doc_id, vector or terms, metadata, features) of documents with a summary.

    ``docs``: celex_number (unique), title, summary, keywords array, tier. ``encoder``: a pandas UDF
    string -> array<double> (for instance a neural model, see operators.batches.encoder_udf) that gives ``vector``; the
    default gives ``terms``, sparse tf-idf vectors over all terms, fitted on the summaries.
    """
    held = infer_features(docs.filter(F.coalesce(F.trim("summary"), F.lit("")) != ""))
    joined = F.concat_ws(" ", F.col("keywords"))
    n = F.col("num_keywords")
    if encoder is not None:
        coded = held.withColumns({"_s": encoder(F.col("summary")), "_k": encoder(joined)})
        vector = vc.blend(F.col("_s"), F.when(n > 0, F.col("_k")), n, fixed_summary_weight).alias("vector")
    else:
        lean = held.select("celex_number", "summary", joined.alias("_j"))
        idf, count = tm.term_idf(lean, tx.tokens(F.col("summary")))
        idf = materialise(idf, "idf")
        coded = held
        for text, out in (("summary", "_s"), ("_j", "_k")):
            sparse = tm.sparse_vectors(lean, "celex_number", tx.tokens(F.col(text)), idf, count)
            coded = coded.join(sparse.withColumnRenamed("terms", out), "celex_number")
        vector = tm.blend_terms(F.col("_s"), F.when(n > 0, F.col("_k")), n, fixed_summary_weight).alias("terms")
    meta = F.struct("celex_number", "title", "summary", F.concat_ws(",", "keywords").alias("keywords"), "tier", "num_keywords",
                    "document_type", "form")
    return coded.select(F.col("celex_number").alias("doc_id"), vector, meta.alias("metadata"), "features")


def upsert_vectors(current: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace those of the same id; of several with one id the largest by its components stays."""
    return upsert(current, new, ["doc_id"], ["vector"])


def save_state(vectors: DataFrame, vocab: DataFrame, settings: Settings, path: str) -> None:
    """Vector table, vocabulary, settings and a count row, as tables below ``path``."""
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    stored = spark.read.parquet(f"{path}/vectors")
    info = stored.agg(F.count("*").alias("documents")).withColumns(
        {"saved_at": F.current_timestamp(), "settings": F.lit(json.dumps(asdict(settings)))})
    info.write.mode("overwrite").json(f"{path}/state")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Settings]:
    state = spark.read.schema("documents long, saved_at timestamp, settings string").json(f"{path}/state")
    held = json.loads(state.first()["settings"])
    held["multi_valued"] = tuple(held["multi_valued"])
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/vocabulary"), Settings(**held)
