"""Scores and boosts of a recommendation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights.
TEXT_WEIGHT, CATEGORY_WEIGHT = 0.7, 0.3
FEATURE_WEIGHTS = {
    "form": 0.15, "subject_matters": 0.25, "eurovoc_descriptors": 0.25, "authors": 0.10, "directory_codes": 0.15,
    "responsible_body": 0.10,
}
MULTI_VALUED = ("subject_matters", "eurovoc_descriptors", "authors", "directory_codes")
DECAY_DAYS, WINDOW_DAYS = 730.0, 3650.0


def pair_score(text: Column, category: Column, tw: float = TEXT_WEIGHT, cw: float = CATEGORY_WEIGHT) -> Column:
    """tw * text + cw * category; weights must lie in 0..1 and sum to 1."""
    if not (0 <= tw <= 1 and 0 <= cw <= 1 and abs(tw + cw - 1) < 1e-9):
        raise ValueError("weights must lie in 0..1 and sum to 1")
    return F.lit(tw) * text + F.lit(cw) * category


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b|; 0 when both are empty."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")),
        F.lit(0.0),
    )


def feature_match(query: Column, doc: Column, weights: Mapping[str, float], multi=MULTI_VALUED) -> Column:
    """Weighted mean over the features both sides know: Jaccard for multi-valued ones, equality for the rest.

    ``query`` and ``doc`` are map<string,array<string>>. NULL when no weighted feature is shared.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        q, d = F.try_element_at(query, F.lit(name)), F.try_element_at(doc, F.lit(name))
        known = q.isNotNull() & d.isNotNull()
        match = jaccard(q, d) if name in multi else (F.get(q, F.lit(0)) == F.get(d, F.lit(0))).cast("double")
        total = total + F.when(known, F.lit(float(w)) * F.coalesce(match, F.lit(0.0))).otherwise(0.0)
        weight = weight + F.when(known, F.lit(float(w))).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def combined(text: Column, category: Column, tw=TEXT_WEIGHT, cw=CATEGORY_WEIGHT) -> Column:
    """tw * text + cw * category where a category score is known, else the text score."""
    tw, cw = (w if isinstance(w, Column) else F.lit(float(w)) for w in (tw, cw))
    return F.coalesce(tw * text + cw * category, text)


def presence_bonus(doc: Column, preferences: Column) -> Column:
    """Sum of the weights of preferred features the document has at all (preferences: map<string,double>)."""
    hits = F.map_filter(preferences, lambda k, _: F.map_contains_key(doc, k))
    return F.aggregate(F.map_values(hits), F.lit(0.0), lambda s, w: s + w)


def value_bonus(doc: Column, preferences: Column) -> Column:
    """Sum of the weights of document values found in preferences (map<string,map<string,double>>)."""

    def one(entry: Column) -> Column:
        values = F.coalesce(F.try_element_at(doc, entry["key"]), F.array().cast("array<string>"))
        return F.aggregate(
            values, F.lit(0.0), lambda s, v: s + F.coalesce(F.try_element_at(entry["value"], v), F.lit(0.0))
        )

    return F.aggregate(F.map_entries(preferences), F.lit(0.0), lambda s, e: s + one(e))


def recency(date: Column, reference: Column, kind: str = "exponential") -> Column:
    """Temporal score of a date, NULL where undated (and, for ``exponential``, where it lies in the future)."""
    days = F.datediff(reference, date).cast("double")
    if kind == "exponential":
        return F.when(days >= 0, F.exp(-days / F.lit(DECAY_DAYS)))
    if kind == "sqrt":
        past = F.lit(1.0) - F.sqrt(F.least(days, F.lit(WINDOW_DAYS)) / F.lit(WINDOW_DAYS))
        return F.when(days >= 0, past).when(days < 0, F.lit(0.5))
    if kind == "linear":
        return F.when(days.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(days) / F.lit(WINDOW_DAYS)))
    raise ValueError(f"unknown recency kind {kind!r}")


def recency_boost(score: Column, date: Column, reference: Column, weight, kind: str = "exponential") -> Column:
    """(1 - b) * score + b * recency; the score is kept where recency is unknown. b is held within 0..1."""
    b = weight if isinstance(weight, Column) else F.lit(min(1.0, max(0.0, float(weight))))
    return F.coalesce((F.lit(1.0) - b) * score + b * recency(date, reference, kind), score)


def feedback_boost(score: Column, average: Column, factor: float = 0.2) -> Column:
    """score * (1 + (avg - 1) / 4 * factor); unrated results keep their score."""
    return score * (F.lit(1.0) + F.coalesce((average - 1) / 4, F.lit(0.0)) * F.lit(factor))
