"""Vector arithmetic over array<double> columns (small per-row work; bulk scoring is in operators.similarity)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays as it is."""
    return let(v, lambda w: let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scale(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def weighted_sum(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def keyword_weight(n: Column, fixed_summary_weight: float | None = None) -> Column:
    """Weight of the keyword vector for n keywords: 0.1 + 0.01667 (n - 2), held within 0.1..0.4."""
    if fixed_summary_weight is not None:
        return F.lit(1.0 - min(1.0, max(0.0, fixed_summary_weight)))
    return F.greatest(F.lit(0.1), F.least(F.lit(0.4), F.lit(0.1) + F.lit(0.01667) * (n - 2)))


def blend(summary: Column, keywords: Column, n: Column, fixed_summary_weight: float | None = None,
          normalise: bool = True) -> Column:
    """Summary and keyword vectors as one; a missing side leaves the other."""
    wk = keyword_weight(n, fixed_summary_weight)
    mixed = F.when(keywords.isNull(), summary).when(summary.isNull(), keywords).otherwise(
        weighted_sum(summary, F.lit(1.0) - wk, keywords, wk)
    )
    return unit(mixed) if normalise else mixed


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Feature weights: negatives become 0; rescaled to sum 1 when off by more than 0.01."""
    held = {k: max(0.0, float(w)) for k, w in weights.items()}
    total = sum(held.values())
    if total > 0 and abs(total - 1.0) > 0.01:
        held = {k: w / total for k, w in held.items()}
    return held


def rescale(*weights: float) -> tuple[float, ...]:
    """A weight group rescaled to sum 1 (any number of members)."""
    total = sum(weights)
    if total <= 0:
        raise ValueError("weights sum to zero")
    return tuple(w / total for w in weights)


def encode(values: Column, vocabulary: Sequence[str], weight: float, multi: bool = True) -> Column:
    """One feature as a weighted one-/multi-hot vector; unknown values give nothing, missing gives zeros.

    A list on a single-valued feature counts with its first element.
    """
    held = F.coalesce(values, F.array().cast("array<string>"))
    held = held if multi else F.slice(held, 1, 1)
    return F.transform(
        F.array(*(F.lit(v) for v in vocabulary)),
        lambda v: F.when(F.array_contains(held, v), F.lit(float(weight))).otherwise(F.lit(0.0)),
    )
