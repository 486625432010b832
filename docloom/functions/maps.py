"""Map helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(base: Column, winner: Column) -> Column:
    """Both maps as one; on a shared key the winner's value stays."""
    return (
        F.when(base.isNull(), winner)
        .when(winner.isNull(), base)
        .otherwise(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(winner, k)), winner))
    )


def keep_keys(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def features_from_json(c: Column) -> Column:
    return F.from_json(c, "map<string,array<string>>")


def as_text(m: Column) -> Column:
    """Sorted ``k=v`` text of a map<string,…>, for export and comparison."""
    return F.array_join(
        F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";"
    )
