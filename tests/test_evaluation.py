"""Ranking metrics against hand-worked and brute-force values."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import evaluation as ev
from docloom.plans import sweep as sw


def test_published_point(spark):
    """One hit at rank 1, ten relevant documents."""
    results = spark.createDataFrame([("q", f"d{i}", 1.0 - i / 100, i) for i in range(1, 11)], "query_id string, doc_id string, score double, rank int")
    rel = spark.createDataFrame([("q", "d1", 1.0)] + [("q", f"x{i}", 1.0) for i in range(9)], "query_id string, doc_id string, rel double")
    r = ev.query_metrics(results, rel, (5, 10)).first()
    assert (round(r.ndcg_5, 4), round(r.ndcg_10, 4)) == (0.3392, 0.2201)
    assert (r.precision_5, r.precision_10, r.recall_5, r.recall_10, r.map_5, r.map_10) == (0.2, 0.1, 0.1, 0.1, 0.2, 0.1)


def test_short_lists_divide_by_what_was_returned(spark):
    results = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    rel = spark.createDataFrame([("q", "a", 1.0)], "query_id string, doc_id string, rel double")
    r = ev.query_metrics(results, rel, (5,)).first()
    assert (r.precision_5, r.recall_5, r.ndcg_5, r.map_5) == (0.5, 1.0, 1.0, 1.0)


def test_query_without_judgements_counts_zero(spark):
    results = spark.createDataFrame([("q", "a", 1.0, 1)], "query_id string, doc_id string, score double, rank int")
    rel = spark.createDataFrame([("other", "a", 1.0)], "query_id string, doc_id string, rel double")
    r = ev.mean_metrics(ev.query_metrics(results, rel, (5,))).first()
    assert (r.precision_5, r.recall_5, r.ndcg_5, r.map_5) == (0.0, 0.0, 0.0, 0.0)


def test_diversity_without_pairs_equals_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 5))
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(12)], "doc_id int, vector array<double>")
    lists = {"a": [0, 1, 2, 3], "b": [4, 5, 6], "c": [7]}
    results = spark.createDataFrame([(q, d, r) for q, ds in lists.items() for r, d in enumerate(ds, 1)], "query_id string, doc_id int, rank int")
    got = {r.query_id: r.diversity for r in ev.diversity(results, vectors, 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, ds in lists.items():
        pairs = [u[i] @ u[j] for i, j in itertools.combinations(ds[:3], 2)]
        assert abs(got[q] - (1 - np.mean(pairs) if pairs else 1.0)) < 1e-6


def test_list_overlap_over_blocks(spark):
    rng = np.random.default_rng(5)
    lists = {i: set(rng.choice(30, size=6, replace=False).tolist()) for i in range(25)}
    results = spark.createDataFrame([(q, int(d)) for q, ds in lists.items() for d in ds], "query_id int, doc_id int")
    want = np.mean([len(a & b) / len(a | b) for a, b in itertools.combinations(lists.values(), 2)])
    for rows in (1024, 6):
        assert abs(ev.mean_list_jaccard(results, rows).first()[0] - want) < 1e-6


def test_list_overlap_of_equal_empty_and_hot_lists(spark):
    """Most lists share a document, many are equal, some have no documents; no pair of lists without a common document is formed."""
    rng = np.random.default_rng(11)
    lists = {i: ({"hot"} if i % 3 else set()) | {f"d{x}" for x in rng.choice(40, size=i % 5, replace=False)} for i in range(60)}
    lists |= {100 + i: {"a", "b", "hot"} for i in range(20)} | {200 + i: {f"own{i}"} for i in range(10)}
    results = spark.createDataFrame([(q, d) for q, ds in lists.items() for d in ds or [None]], "query_id int, doc_id string")
    pairs = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in itertools.combinations(lists.values(), 2)]
    for rows in (1024, 7):
        assert abs(ev.mean_list_jaccard(results, rows).first()[0] - np.mean(pairs)) < 1e-6
    assert ev.mean_list_jaccard(results.where("query_id < 0")).first()[0] == 0.0
    plan = ev.mean_list_jaccard(results, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan  # blocks of all lists against all took quadratic time


def test_grids():
    grid = sw.weight_grid({"text": [0.0, 0.5, 1.0], "category": [0.0, 0.5, 1.0]})
    assert all(abs(sum(g.values()) - 1) < 1e-6 for g in grid) and len(grid) == 5
    assert len(sw.simplex_grid(["a", "b", "c"], 0.1)) == 66


def test_first_maximum_wins(spark):
    search = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "config int, ndcg_10 double")
    assert sw.best(search).first().config == 1


def test_categorical_diversity(spark):
    results = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("s", 1, 1)], "query_id string, doc_id int, rank int")
    rows = spark.createDataFrame([(1, "form", "x"), (2, "form", "x"), (1, "type", "a"), (2, "type", "b")], "doc_id int, feature string, value string")
    got = {r.query_id: r.categorical_diversity for r in ev.categorical_diversity(results, rows, 5).collect()}
    assert got == {"q": 0.75}


def test_industry(spark):
    from docloom.functions import keys as ky

    results = spark.createDataFrame([("pharma_01", 1), ("pharma_02", 1), ("waste_01", 2)], "query_id string, doc_id int")
    got = {r.industry: (r.clients, r.unique_documents) for r in ev.industry_coverage(results, ky.industry(F.col("query_id"))).collect()}
    assert got == {"pharma": (2, 1), "waste": (1, 1)}


def test_class_metrics_equal_written_out_judgements(spark):
    rng = np.random.default_rng(9)
    labels = {i: int(rng.integers(0, 3)) for i in range(20)}
    labels[20] = 99                                    # alone in its class: nothing is relevant
    classes = spark.createDataFrame(list(labels.items()), "doc_id int, label int")
    rel = spark.createDataFrame([(a, b, 1.0) for a in labels for b in labels if a != b and labels[a] == labels[b]], "query_id int, doc_id int, rel double")
    rows = [(q, int(d), r) for q in labels for r, d in enumerate(rng.permutation([x for x in labels if x != q])[:10], 1)]
    results = spark.createDataFrame(rows, "query_id int, doc_id int, rank int")
    a = sorted(map(tuple, ev.query_metrics(results, rel, (5, 10)).collect()))
    b = sorted(map(tuple, ev.class_metrics(results, classes, (5, 10)).collect()))
    assert a == b
