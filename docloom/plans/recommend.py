"""Recommendations for many queries, documents or profiles in one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps as mp
from ..functions import scores as sc
from ..functions import text as tx
from ..functions import vectors as vc
from ..operators import categories as cg
from ..operators import features as ft
from ..operators import terms as tm
from ..operators.ranking import rank_results
from ..operators.similarity import mean_vectors, top_k
from ..session import materialise

# Final scores are compared at this precision; candidates were cut at six places.
SCORE_DIGITS = 9


@dataclass(frozen=True)
class Settings:
    """Query-time parameters; stored vectors do not depend on them, so changing a weight rebuilds nothing."""

    top_k: int = 10
    candidate_factor: int = 2
    text_weight: float = sc.TEXT_WEIGHT
    category_weight: float = sc.CATEGORY_WEIGHT
    feature_weights: Mapping[str, float] = field(default_factory=lambda: dict(sc.FEATURE_WEIGHTS))
    multi_valued: tuple[str, ...] = sc.MULTI_VALUED
    use_features: bool = True
    recency_weight: float | None = None
    recency_kind: str = "exponential"
    reference_date: str | None = None
    min_similarity: float | None = None


def metadata_filter(docs: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Equality filter before any scoring; it reaches the scan."""
    for name, value in wanted.items():
        docs = docs.filter(F.col(name) == F.lit(value))
    return docs


def candidates(queries: DataFrame, docs: DataFrame, s: Settings, skip_self: bool = False) -> DataFrame:
    """First stage: the best ``candidate_factor * top_k`` documents by text score alone."""
    k = s.top_k * s.candidate_factor if s.use_features else s.top_k
    return top_k(queries, docs, k, skip_self=skip_self).withColumnRenamed("score", "text_score").drop("rank")


def components(found: DataFrame, queries: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Candidates with the feature-match score (NULL when nothing is comparable) and the document date."""
    side = docs.select("doc_id", F.col("features").alias("_doc"), *(["date"] if "date" in docs.columns else []))
    asked = queries.select(
        "query_id", F.col("features").alias("_query"),
        *([F.col("preferences").alias("_pref")] if "preferences" in queries.columns else []),
    )
    joined = found.join(side, "doc_id").join(asked, "query_id")
    match = sc.feature_match(F.col("_query"), F.col("_doc"), s.feature_weights, s.multi_valued)
    return joined.withColumn("category_score", match)


def rescore(rows: DataFrame, s: Settings) -> DataFrame:
    """Second stage: weighted score, preference bonus, recency, final rank."""
    score = sc.combined(F.col("text_score"), F.col("category_score"), s.text_weight, s.category_weight) if s.use_features else F.col("text_score")
    if "_pref" in rows.columns:
        score = score + F.coalesce(sc.value_bonus(F.col("_doc"), F.col("_pref")), F.lit(0.0))
    out = rows.withColumn("score", score)
    if s.recency_weight is not None:
        reference = F.lit(s.reference_date).cast("date") if s.reference_date else F.current_date()
        out = out.withColumn("score", sc.recency_boost(F.col("score"), F.col("date"), reference, s.recency_weight, s.recency_kind))
    out = out.withColumn("score", F.round("score", SCORE_DIGITS)).drop("_doc", "_query", "_pref")
    if s.min_similarity is not None:
        out = out.filter(F.col("score") >= s.min_similarity)
    return rank_results(out, s.top_k)


def recommend(queries: DataFrame, docs: DataFrame, s: Settings = Settings(), skip_self: bool = False) -> DataFrame:
    """Queries (query_id, vector[, features, preferences]) against documents (doc_id, vector[, features, date]).

    Over-fetches by text score, then re-scores the few candidates. Returns query_id, doc_id, text_score,
    category_score, score, rank.
    """
    return _rescored(candidates(queries, docs, s, skip_self), queries, docs, s)


def _rescored(found: DataFrame, queries: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    if not s.use_features:
        dated = found.join(docs.select("doc_id", "date"), "doc_id") if "date" in docs.columns else found
        return rescore(dated, s)
    return rescore(components(found, queries, docs, s), s)


def recommend_by_document(docs: DataFrame, s: Settings = Settings(), asked: DataFrame | None = None) -> DataFrame:
    """Documents like a document: its own vector and features are the query, itself left out.

    ``asked``: frame of doc_id to ask for; all documents when None.
    """
    source = docs if asked is None else docs.join(asked.select("doc_id"), "doc_id", "left_semi")
    return recommend(source.withColumnRenamed("doc_id", "query_id"), docs, s, skip_self=True)


# -- text queries --------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TextIndex:
    """Weighted postings (term, doc_id, w) of a corpus, vector lengths (doc_id, length), and the terms' idf, all written."""

    weights: DataFrame
    lengths: DataFrame
    idf: DataFrame
    n: int

    def postings(self) -> DataFrame:
        """(term, doc_id, w) of unit vectors."""
        return self.weights.join(self.lengths, "doc_id").select("term", "doc_id", (F.col("w") / F.col("length")).alias("w"))

    def encode(self, df: DataFrame, key: str, text: Column) -> DataFrame:
        """(key, terms) of a text column."""
        return tm.sparse_vectors(df, key, tx.tokens(text), self.idf, self.n)


def text_index(docs: DataFrame, text: str = "content") -> TextIndex:
    """Tf-idf index over all terms of a corpus (doc_id, text); no dimension, no vocabulary on the driver."""
    counted = materialise(docs.select("doc_id", tx.term_counts(tx.tokens(F.col(text))).alias("c")), "counts")
    n = counted.count()
    rows = counted.select("doc_id", F.explode("c").alias("c")).select("doc_id", F.col("c.term").alias("term"), F.col("c.tf").alias("tf"))
    idf = materialise(tm.idf_of(rows.groupBy("term").agg(F.count("*").alias("df")), n), "idf")
    weights = materialise(rows.join(idf, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("w")).where("w > 0"), "weights")
    lengths = materialise(weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")), "lengths")
    return TextIndex(weights, lengths, idf, n)


def encode_queries(queries: DataFrame, index: TextIndex, text: str = "query", keywords: str | None = None,
                   embedding_type: str = "combined", fixed_summary_weight: float | None = None) -> DataFrame:
    """Queries with their vector (``terms``) from text, keywords (array) or both; query_id is unique."""
    if keywords is None or embedding_type == "summary":
        return queries.join(index.encode(queries, "query_id", F.col(text)), "query_id")
    joined = index.encode(queries, "query_id", F.concat_ws(" ", F.col(keywords))).withColumnRenamed("terms", "_key")
    if embedding_type == "keyword":
        return queries.join(joined.withColumnRenamed("_key", "terms"), "query_id")
    both = queries.join(index.encode(queries, "query_id", F.col(text)).withColumnRenamed("terms", "_text"), "query_id").join(joined, "query_id")
    n = F.size(keywords)
    mixed = tm.blend_terms(F.col("_text"), F.when(n > 0, F.col("_key")), n, fixed_summary_weight)
    return both.withColumn("terms", mixed).drop("_text", "_key")


def recommend_by_text(queries: DataFrame, index: TextIndex, s: Settings = Settings(), docs: DataFrame | None = None) -> DataFrame:
    """Encoded queries (query_id, terms[, features, preferences]) against an index, re-scored as ``recommend`` does.

    ``docs`` holds features and dates (doc_id, features[, date]) where the settings use them.
    """
    k = s.top_k * s.candidate_factor if s.use_features else s.top_k
    found = tm.top_k_terms(queries, index.postings(), k).withColumnRenamed("score", "text_score").drop("rank")
    return _rescored(found, queries, index.lengths if docs is None else docs, s)


# -- profiles ------------------------------------------------------------------------------------------------

# Weights (expert, history) of the evaluation modes with a vector; a missing part leaves the other.
PROFILE_MODES = {"combined": (0.5, 0.5), "expert": (1.0, 0.0), "historical": (0.0, 1.0)}
# The mode without a vector: profiles meet documents by their preferred categories alone.
CATEGORICAL_MODE = "categorical"


def profile_vectors(expert: DataFrame, history: DataFrame, vectors: DataFrame, we: float = 0.5, wh: float = 0.5) -> DataFrame:
    """Composite vector per user: we * expert + wh * mean(history), length 1; either part may be missing.

    ``expert``: (user_id, vector); ``history``: (user_id, doc_id); ``vectors``: (doc_id, vector).
    """
    mean = mean_vectors(history.join(vectors.select("doc_id", "vector"), "doc_id"), "user_id").select(
        "user_id", F.col("vector").alias("_h"))
    both = expert.select("user_id", vc.as_double(F.col("vector")).alias("_e")).join(mean, "user_id", "full_outer")
    e, h = F.col("_e"), F.col("_h")
    mixed = F.when(e.isNull(), h).when(h.isNull(), e).otherwise(vc.weighted_sum(e, F.lit(float(we)), h, F.lit(float(wh))))
    return both.select("user_id", vc.unit(mixed).alias("vector"))


def personalised_queries(profiles: DataFrame, queries: DataFrame | None = None, wp: float = 0.5, wq: float = 0.5) -> DataFrame:
    """Profile vectors blended with a user's queries; users without a query ask with the profile alone.

    ``profiles``: (user_id, vector, features); ``queries``: (user_id, query_id, vector, features).
    """
    if queries is None:
        return profiles.withColumn("query_id", F.col("user_id"))
    p = profiles.select("user_id", F.col("vector").alias("_p"), F.col("features").alias("_pf"))
    q = queries.select("user_id", "query_id", F.col("vector").alias("_q"), F.col("features").alias("_qf"))
    joined = p.join(q, "user_id", "full_outer")
    vector = F.when(F.col("_q").isNull(), F.col("_p")).when(F.col("_p").isNull(), F.col("_q")).otherwise(
        vc.unit(vc.weighted_sum(F.col("_p"), F.lit(float(wp)), F.col("_q"), F.lit(float(wq)))))
    return joined.select(
        "user_id", F.coalesce("query_id", F.col("user_id")).alias("query_id"), vector.alias("vector"),
        mp.merge(F.col("_pf"), F.col("_qf")).alias("features"),
    )


def recommend_for_profiles(profiles: DataFrame, docs: DataFrame, s: Settings = Settings(), queries: DataFrame | None = None,
                           wp: float = 0.5, wq: float = 0.5) -> DataFrame:
    """Personalised recommendations for all users at once."""
    return recommend(personalised_queries(profiles, queries, wp, wq), docs, s)


def recommend_categorical(profiles: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Profiles (query_id, features) against documents (doc_id, features) by categories alone; no vector is read.

    Only documents that share a value with the profile are results; recency and ``min_similarity`` apply as elsewhere.
    """
    if s.recency_weight is None and s.min_similarity is None:
        return cg.top_k_categories(profiles, docs, s.top_k, s.feature_weights, s.multi_valued)
    found = cg.top_k_categories(profiles, docs, s.top_k * s.candidate_factor, s.feature_weights, s.multi_valued)
    dated = found.drop("rank").withColumnRenamed("score", "text_score").join(docs.select("doc_id", "date"), "doc_id")
    return rescore(dated, replace(s, use_features=False)).select("query_id", "doc_id", "score", "rank")


# -- ranking a corpus against interest profiles ----------------------------------------------------------------

def rank_corpus(queries: DataFrame, docs: DataFrame, s: Settings = Settings(recency_kind="sqrt")) -> DataFrame:
    """Rank documents by text and categories in one product; both sides carry the weights (squared in the score).

    Scores are held within 0..1, ``min_similarity`` filters, recency re-ranks. Features are map<string,array<string>>
    with any number of values: categories stay sparse.
    """

    def two(df: DataFrame, key: str) -> DataFrame:
        cats = ft.scaled_to(ft.categories(F.col("features"), s.feature_weights, s.multi_valued), s.category_weight)
        return df.select(key, vc.scale(vc.unit(vc.as_double(F.col("vector"))), F.lit(s.text_weight)).alias("vector"), cats.alias("categories"))

    q, d = two(queries, "query_id"), two(docs, "doc_id")
    found = top_k(q, d, s.top_k, normalise=False)
    clamped = found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    floor = s.min_similarity or 0.0
    kept = clamped.filter(F.col("score") >= floor).drop("rank")
    if s.recency_weight is not None:
        reference = F.lit(s.reference_date).cast("date") if s.reference_date else F.current_date()
        dated = kept.join(docs.select("doc_id", "date"), "doc_id", "left")
        kept = dated.withColumn(
            "score", F.round(sc.recency_boost(F.col("score"), F.col("date"), reference, s.recency_weight, s.recency_kind), SCORE_DIGITS)
        ).drop("date")
    return rank_results(kept)


def with_weights(s: Settings, **changes) -> Settings:
    """Settings with other weights; nothing stored has to be rebuilt."""
    return replace(s, **changes)
