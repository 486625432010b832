"""Ranking quality and weight search."""

from pyspark.sql import functions as F

from docloom.functions import keys as ky
from docloom.operators import evaluation as ev
from docloom.operators import monitoring as mo
from docloom.plans import sweep as sw
from docloom.plans.recommend import CATEGORICAL_MODE, PROFILE_MODES, Settings, profile_vectors, recommend_categorical
from docloom.plans.recommend import candidates as rc_candidates
from docloom.plans.recommend import components as rc_components

from .base import Tables, query
from .scoring import FEATURE_ROWS_SQL, feature_rows, queries_of, sims10


def components(t: Tables):
    q, s = queries_of(t), Settings()
    return rc_components(rc_candidates(q, t.vecs, s, skip_self=True), q, t.vecs, s)


def by_label(t: Tables):
    """Metrics of swept rankings; documents of the same label are relevant to each other."""
    return lambda ranked: ev.class_metrics(ranked, t.vecs, (5, 10), ["config"])


def graded(t: Tables):
    """Graded judgements: the ten documents nearest by category mostly, graded 1 to 3 by id."""
    top = sw.apply_weights(components(t), [{"text": 0.1, "category": 0.9}])
    return top.select("query_id", "doc_id", (F.pmod("doc_id", F.lit(3)) + 1).cast("double").alias("rel"))


GRADED_SQL = """(SELECT query_id, doc_id, (1 + doc_id % 3)::DOUBLE AS rel FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.1::DOUBLE * text_score + 0.9::DOUBLE * category_score, 9) DESC, doc_id) AS r FROM comps) WHERE r <= 10)"""


def _metrics_sql(source: str, ks, group: str = "") -> str:
    """Metrics of ranked rows (query_id, doc_id, rank[, config]) in source."""
    g = f"{group}, " if group else ""
    cols = []
    for k in ks:
        cols.append(f"""round(coalesce(sum((rel > 0 AND rank <= {k})::INT)::DOUBLE / nullif(count(*) FILTER (rank <= {k}), 0), 0), 6) AS precision_{k},
          round(coalesce(sum((rel > 0 AND rank <= {k})::INT)::DOUBLE / nullif(any_value(relevant), 0), 0), 6) AS recall_{k},
          round(coalesce(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END)::DOUBLE / nullif(any_value(ideal_{k}), 0), 0), 6) AS ndcg_{k},
          round(coalesce(sum(CASE WHEN rank <= {k} AND rel > 0 THEN hits::DOUBLE / rank ELSE 0 END)::DOUBLE / nullif(least(any_value(relevant), {k}), 0), 0), 6) AS map_{k}""")
    ideal = ", ".join(f"sum(CASE WHEN pos <= {k} THEN 1.0::DOUBLE / log2(pos + 1) END) AS ideal_{k}" for k in ks)
    return f"""(SELECT {g}query_id, {', '.join(cols)} FROM (SELECT r.*, coalesce(j.rel, 0)::DOUBLE AS rel, i.*  EXCLUDE (query_id), sum((coalesce(j.rel, 0) > 0)::INT) OVER (PARTITION BY {g.replace(group, 'r.' + group) if group else ''}r.query_id ORDER BY rank) AS hits
        FROM {source} r LEFT JOIN judgements j ON j.query_id = r.query_id AND j.doc_id = r.doc_id
        LEFT JOIN (SELECT query_id, count(*) AS relevant, {ideal} FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM judgements) GROUP BY 1) i ON i.query_id = r.query_id) GROUP BY {g}query_id)"""


def _metric(name: str, covers: str, metric: str):
    cols = [f"{metric}_{k}" for k in (5, 10)]

    @query(name, covers, f"SELECT query_id, {', '.join(cols)} FROM {_metrics_sql('top10', (5, 10))}")
    def run(t: Tables):
        return ev.class_metrics(sims10(t), t.vecs, (5, 10)).select("query_id", *cols)


_metric("precision_at_k", "EVL1", "precision")
_metric("recall_at_k", "EVL2", "recall")
_metric("ndcg_at_k", "EVL3", "ndcg")
_metric("map_at_k", "EVL4", "map")


@query("mean_metrics", "EVL6", "SELECT " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10, 20) for m in ev.METRICS) + f" FROM {_metrics_sql('top10', (5, 10, 20))}")
def mean_metrics(t: Tables):
    return ev.mean_metrics(ev.class_metrics(sims10(t), t.vecs))


@query("graded_ndcg", "EVL3", f"""WITH g AS {GRADED_SQL}, i AS (SELECT query_id, sum(rel / log2(pos + 1)) AS ideal FROM
      (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS pos FROM g) WHERE pos <= 10 GROUP BY 1)
    SELECT query_id, round(sum(coalesce(rel, 0) / log2(rank + 1)) / any_value(ideal), 6) AS ndcg_10 FROM top10 LEFT JOIN g USING (query_id, doc_id) JOIN i USING (query_id) GROUP BY 1""")
def graded_ndcg(t: Tables):
    return ev.query_metrics(sims10(t), graded(t), (10,)).select("query_id", "ndcg_10")


_PAIR_SQL = """(SELECT a.query_id, avg(list_cosine_similarity(x.vector, y.vector)) AS c FROM top10 a JOIN top10 b ON a.query_id = b.query_id AND a.rank < b.rank JOIN vecs x ON x.doc_id = a.doc_id JOIN vecs y ON y.doc_id = b.doc_id WHERE b.rank <= {k} GROUP BY 1)"""


@query("diversity_at_10", "EVL5", f"SELECT query_id, round(1 - c, 6) AS diversity FROM {_PAIR_SQL.format(k=10)}")
def diversity_at_10(t: Tables):
    return ev.diversity(sims10(t), t.vecs, 10)


@query("content_diversity", "EVL7", f"SELECT query_id, round(1 - c, 6) AS diversity FROM {_PAIR_SQL.format(k=5)}")
def content_diversity(t: Tables):
    return ev.diversity(sims10(t), t.vecs, 5, single=0.0)


@query("categorical_diversity", "EVL8", f"""SELECT query_id, round(avg(d), 6) AS categorical_diversity, count(*) AS features FROM (SELECT query_id, feature, count(DISTINCT value)::DOUBLE / count(*) AS d FROM top10 JOIN {FEATURE_ROWS_SQL} f USING (doc_id) WHERE rank <= 5 GROUP BY 1, 2) GROUP BY 1""")
def categorical_diversity(t: Tables):
    return ev.categorical_diversity(sims10(t), feature_rows(t), 5)


@query("recommended_value_counts", "EVL8", f"SELECT feature, value, count(*) AS n FROM top10 JOIN {FEATURE_ROWS_SQL} f USING (doc_id) WHERE rank <= 5 GROUP BY 1, 2")
def recommended_value_counts(t: Tables):
    return ev.value_counts(sims10(t), feature_rows(t), 5)


@query("coverage_totals", "EVL9", "SELECT count(*) AS total, count(DISTINCT doc_id) AS unique_documents, round(count(DISTINCT doc_id)::DOUBLE / count(*), 6) AS uniqueness_ratio FROM top10")
def coverage_totals(t: Tables):
    return ev.coverage(sims10(t))


@query("average_list_overlap", "EVL9", """WITH n AS (SELECT count(DISTINCT query_id) AS n FROM top10), p AS (SELECT a.query_id AS x, b.query_id AS y, count(*) AS i FROM top10 a JOIN top10 b ON a.doc_id = b.doc_id AND a.query_id < b.query_id GROUP BY 1, 2)
    SELECT round(sum(i / (20.0::DOUBLE - i)) / any_value(n * (n - 1) / 2.0::DOUBLE), 6) AS average_overlap FROM p, n""")
def average_list_overlap(t: Tables):
    return ev.mean_list_jaccard(sims10(t))


@query("industry_coverage", "EVL9", """SELECT 'i' || (query_id % 7) AS industry, count(DISTINCT query_id) AS clients, count(DISTINCT doc_id) AS unique_documents, round(count(DISTINCT doc_id)::DOUBLE / count(DISTINCT query_id), 6) AS documents_per_client FROM top10 GROUP BY 1""")
def industry_coverage(t: Tables):
    client = F.concat(F.lit("i"), F.pmod("query_id", F.lit(7)).cast("string"), F.lit("_"), F.col("query_id").cast("string"))
    return ev.industry_coverage(sims10(t), ky.industry(client))


GRID = sw.weight_grid({"text": [0.0, 0.25, 0.5, 0.75, 1.0], "category": [0.0, 0.25, 0.5, 0.75, 1.0]})
SIMPLEX = sw.simplex_grid(["text", "category"], 0.25)


def _configs_sql(configs) -> str:
    rows = ", ".join(f"({i}, {c['text']}::DOUBLE, {c['category']}::DOUBLE)" for i, c in enumerate(configs))
    return f"(SELECT * FROM (VALUES {rows}) AS v(config, tw, cw))"


def _ranked_sql(configs, k: int = 10) -> str:
    return f"""(SELECT config, query_id, doc_id, score, rank FROM (SELECT config, query_id, doc_id, score, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM
        (SELECT config, query_id, doc_id, round(tw * text_score + cw * category_score, 9) AS score FROM comps, {_configs_sql(configs)} c)) WHERE rank <= {k})"""


def _search_sql(configs) -> str:
    means = ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10) for m in ev.METRICS)
    return f"""(SELECT m.*, tw AS text_weight, cw AS category_weight FROM (SELECT config, {means} FROM {_metrics_sql(_ranked_sql(configs), (5, 10), 'config')} GROUP BY config) m JOIN {_configs_sql(configs)} c USING (config))"""


@query("grid_search", "EVL10 EVL11", f"SELECT * FROM {_search_sql(GRID)}")
def grid_search(t: Tables):
    return sw.grid_search(components(t), by_label(t), GRID)


@query("settings_from_table", "EVL10", f"""SELECT * FROM {_search_sql([{'text': x / 10, 'category': round(1 - x / 10, 9)} for x in range(10)])}""")
def settings_from_table(t: Tables):
    """Settings that come out of a table: one for each label, its tenth as the text's weight."""
    w = F.round(F.col("label") / 10, 9)
    settings = t.vecs.select("label").distinct().select(F.col("label").alias("config"), w.alias("text_weight"), F.round(1 - w, 9).alias("category_weight"))
    return sw.grid_search(components(t), by_label(t), settings)


@query("best_configurations", "TOP6", f"SELECT * FROM {_search_sql(GRID)} ORDER BY ndcg_10 DESC, config LIMIT 3")
def best_configurations(t: Tables):
    return sw.best(sw.grid_search(components(t), by_label(t), GRID), n=3)


@query("simplex_search", "EVL12", f"SELECT * FROM {_search_sql(SIMPLEX)}")
def simplex_search(t: Tables):
    return sw.grid_search(components(t), by_label(t), SIMPLEX)


@query("configurations_side_by_side", "EVL15", f"SELECT query_id, config, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS top_ids FROM {_ranked_sql(SIMPLEX)} WHERE rank <= 5 GROUP BY 1, 2")
def configurations_side_by_side(t: Tables):
    return sw.compare(sw.apply_weights(components(t), SIMPLEX))


_MODES_SQL = """(SELECT user_id, 'combined' AS mode, vector FROM profvec UNION ALL SELECT user_id, 'expert', vector FROM experts UNION ALL
    SELECT e.user_id, 'historical', coalesce(h.vector, e.vector) FROM experts e LEFT JOIN histmean h USING (user_id))"""
_BY_CATEGORY_SQL = """(SELECT user_id, 'categorical' AS mode, doc_id, round((0.15::DOUBLE * same + 0.25::DOUBLE * (shared / (4.0::DOUBLE - shared))) / 0.4::DOUBLE, 9) AS s FROM
    (SELECT p.user_id, v.doc_id, (p.label = v.label)::INT AS same, ((p.label = v.label)::INT + (p.grp = v.grp)::INT) AS shared FROM experts p, vecs v) WHERE shared > 0)"""


@query("mode_sweep", "EVL13", f"""WITH r AS (SELECT user_id, mode, doc_id, row_number() OVER (PARTITION BY user_id, mode ORDER BY s DESC, doc_id) AS rank FROM (
      SELECT p.user_id, mode, v.doc_id, round(list_cosine_similarity(p.vector, v.vector), 6) AS s FROM {_MODES_SQL} p, vecs v UNION ALL SELECT user_id, mode, doc_id, s FROM {_BY_CATEGORY_SQL}))
    SELECT mode, count(*) AS results, sum((h.doc_id IS NOT NULL)::INT)::BIGINT AS hits, count(DISTINCT r.doc_id) AS unique_documents FROM r LEFT JOIN history h USING (user_id, doc_id) WHERE rank <= 10 GROUP BY mode""")
def mode_sweep(t: Tables):
    from docloom.operators.similarity import top_k

    # One frame of queries for all clients and modes with a vector: the mode is a column, so they are one job.
    parts = None
    for mode, (we, wh) in PROFILE_MODES.items():
        p = profile_vectors(t.experts, t.history, t.vecs, we, wh).select(F.concat_ws("|", F.col("user_id").cast("string"), F.lit(mode)).alias("query_id"), "vector")
        parts = p if parts is None else parts.unionByName(p)
    found = top_k(parts, t.vecs, 10).withColumns({"user_id": F.split_part("query_id", F.lit("|"), F.lit(1)).cast("long"), "mode": F.split_part("query_id", F.lit("|"), F.lit(2))})
    by_category = recommend_categorical(t.experts.select(F.col("user_id").alias("query_id"), "features"), t.vecs)
    every = found.select("user_id", "mode", "doc_id").unionByName(by_category.select(F.col("query_id").alias("user_id"), F.lit(CATEGORICAL_MODE).alias("mode"), "doc_id"))
    hist = t.history.withColumn("hit", F.lit(1))
    return every.join(hist, ["user_id", "doc_id"], "left").groupBy("mode").agg(
        F.count("*").alias("results"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count_distinct("doc_id").alias("unique_documents"))


@query("sweep_summary", "EVL14", f"""WITH s AS (SELECT config, query_id % 7 AS client, avg(ndcg_10) AS score FROM {_metrics_sql(_ranked_sql(SIMPLEX), (5, 10), 'config')} GROUP BY 1, 2)
    SELECT config, round(max(score), 6) AS best_score, round(avg(score), 6) AS avg_score, count(*) FILTER (score > 0) AS non_zero, count(*) AS n FROM s GROUP BY 1""")
def sweep_summary(t: Tables):
    per_query = by_label(t)(sw.apply_weights(components(t), SIMPLEX))
    flat = per_query.groupBy("config", F.pmod("query_id", F.lit(7)).alias("client")).agg(F.avg("ndcg_10").alias("score"))
    return sw.sweep_summary(flat).withColumn("best_score", F.round("best_score", 6))


@query("latency_by_type", "EVL16", "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def latency_by_type(t: Tables):
    return mo.latency_summary(t.raw("events"), "value", "event_type")
