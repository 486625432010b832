"""Weight search: every configuration over every query in one job."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import evaluation as ev
from ..operators.ranking import rank_results


def weight_grid(params: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Distinct weight settings: all combinations, all-zero ones left out, rescaled to sum 1."""
    out: dict[tuple, dict[str, float]] = {}
    for combo in itertools.product(*params.values()):
        total = sum(combo)
        if total <= 0:
            continue
        scaled = tuple(round(w / total, 9) if len(combo) > 1 else w for w in combo)
        out.setdefault(scaled, dict(zip(params, scaled)))
    return list(out.values())


def simplex_grid(names: Sequence[str], step: float = 0.1) -> list[dict[str, float]]:
    """Settings of non-negative multiples of ``step`` that sum to 1."""
    n = round(1 / step)
    combos = (c for c in itertools.product(range(n + 1), repeat=len(names)) if sum(c) == n)
    return [{k: round(v / n, 9) for k, v in zip(names, c)} for c in combos]


Configs = DataFrame | Sequence[Mapping[str, float]]


def config_table(components: DataFrame, configs: Configs) -> DataFrame:
    """Settings as a table (config, text_weight, category_weight); a list is numbered from 0."""
    if isinstance(configs, DataFrame):
        return configs.select("config", "text_weight", "category_weight")
    rows = [(i, float(c["text"]), float(c["category"])) for i, c in enumerate(configs)]
    return components.sparkSession.createDataFrame(rows, "config int, text_weight double, category_weight double")


def apply_weights(components: DataFrame, configs: Configs, top_k: int = 10) -> DataFrame:
    """Component scores (query_id, doc_id, text_score, category_score) ranked under every configuration.

    The component scores are computed once; only the few candidates of a query are repeated per configuration, from one
    array of all settings that is a value of the plan, not part of its text.
    """
    each = F.struct("config", F.col("text_weight").alias("tw"), F.col("category_weight").alias("cw"))
    held = config_table(components, configs).agg(F.array_sort(F.collect_list(each)).alias("all")).scalar()
    rows = components.withColumn("_all", held).withColumn("c", F.explode("_all")).drop("_all")
    score = sc.combined(F.col("text_score"), F.col("category_score"), F.col("c.tw"), F.col("c.cw"))
    scored = rows.select(F.col("c.config").alias("config"), "query_id", "doc_id", F.round(score, 9).alias("score"))
    return rank_results(scored, top_k, group=("config", "query_id"))


def grid_search(components: DataFrame, measure: Callable[[DataFrame], DataFrame], configs: Configs,
                top_k: int = 10) -> DataFrame:
    """Mean metrics per configuration: one row each, with its weights.

    ``measure`` turns ranked rows (config, query_id, doc_id, rank) into metrics per config and query, e.g.
    ``lambda r: query_metrics(r, judgements, (5, 10), ["config"])``.
    """
    means = ev.mean_metrics(measure(apply_weights(components, configs, top_k)), ["config"])
    return means.join(config_table(components, configs), "config")


def best(search: DataFrame, metric: str = "ndcg_10", n: int = 1) -> DataFrame:
    """Best n configurations; on equal scores the first one in grid order wins."""
    return search.orderBy(F.col(metric).desc(), "config").limit(n)


def sweep_summary(flat: DataFrame) -> DataFrame:
    """Flattened sweep rows (client, mode, config, score): best and mean score, non-zero count per configuration."""
    return flat.groupBy("config").agg(
        F.max("score").alias("best_score"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.count_if(F.col("score") > 0).alias("non_zero"), F.count("*").alias("n"),
    )


def compare(ranked: DataFrame, top_n: int = 5) -> DataFrame:
    """Result lists of configurations side by side: one row per (query, configuration) with its first n ids."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "doc_id")))
    return ranked.filter(F.col("rank") <= top_n).groupBy("query_id", "config").agg(
        F.array_join(F.transform(ordered, lambda x: x["doc_id"].cast("string")), ",").alias("top_ids"))
