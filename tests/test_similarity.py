"""Exact top-k against brute force, in one cell and in many."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import similarity as sm


def brute(q, d, k, skip_self, normalise=True):
    out = []
    unit = lambda v: v / np.linalg.norm(v) if normalise and np.linalg.norm(v) > 0 else v
    for qi, qv in q:
        scored = [(-(round(float(unit(qv) @ unit(dv)), 6) + 0.0), di) for di, dv in d if not (skip_self and di == qi)]
        out += [(qi, di, -s, r) for r, (s, di) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frames(spark, q, d, qid="long"):
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in q], f"query_id {qid}, vector array<double>")
    ds = spark.createDataFrame([(i, v.tolist()) for i, v in d], f"doc_id {qid}, vector array<double>").repartition(5)
    return qs, ds


@pytest.mark.parametrize("query_bytes,doc_groups", [(64 << 20, None), (7 * 8 * 8, 5), (64, 1)])
@pytest.mark.parametrize("skip_self", [False, True])
def test_top_k_equals_brute_force(spark, query_bytes, doc_groups, skip_self):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8))
    base[20:40] = base[3]          # a third of the documents are copies: ties at the cut
    base[50] = 0                   # a zero vector scores 0 and does not fail
    d = [(i, base[i]) for i in range(60)]
    q = d[:30]
    qs, ds = frames(spark, q, d)
    got = sm.top_k(qs, ds, 6, skip_self=skip_self, query_bytes=query_bytes, doc_groups=doc_groups)
    rows = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect())
    want = brute(q, d, 6, skip_self)
    assert [(a, b, r) for a, b, _, r in rows] == [(a, b, r) for a, b, _, r in want]
    assert np.allclose([r[2] for r in rows], [w[2] for w in want])


def test_string_ids_and_small_corpus(spark):
    q = [("a", np.array([1.0, 0.0]))]
    d = [("x", np.array([1.0, 1.0])), ("y", np.array([2.0, 0.0]))]
    qs, ds = frames(spark, q, d, "string")
    rows = [(r.doc_id, r["rank"]) for r in sm.top_k(qs, ds, 10).orderBy("rank").collect()]
    assert rows == [("y", 1), ("x", 2)]


def test_no_query_gives_no_rows(spark):
    qs, ds = frames(spark, [(1, np.ones(2))], [(2, np.ones(2))])
    assert sm.top_k(qs.filter("query_id < 0"), ds, 3).count() == 0


def test_same_answer_for_any_partitioning(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.withColumnRenamed("doc_id", "query_id")
    one = sorted(map(tuple, sm.top_k(q, v.coalesce(1), 5).collect()))
    many = sorted(map(tuple, sm.top_k(q, v.repartition(8), 5).collect()))
    assert one == many


def test_top_k_plan_cuts_before_the_shuffle(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    plan = sm.top_k(v.withColumnRenamed("doc_id", "query_id"), v, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_small_query_blocks_do_not_multiply_the_documents(spark):
    """A document is sent once to each bundle of blocks; it was sent to each block, so shuffled bytes grew with the square."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 4)))]
    d = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    found = sm.top_k(d.withColumnRenamed("doc_id", "query_id"), d, 5, skip_self=True, query_bytes=64, doc_groups=2)
    cells = [int(n) for n in re.findall(r"hashpartitioning\(qb#\d+, dg#\d+, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())]
    assert cells and max(cells) <= 2 * spark.sparkContext.defaultParallelism + 2  # 300 blocks, 2 groups
    one = sm.top_k(d.withColumnRenamed("doc_id", "query_id"), d, 5, skip_self=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, one.collect()))


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 5.0])], "g string, vector array<double>")
    got = {r.g: (r.vector, r.members) for r in sm.mean_vectors(df, "g").collect()}
    assert got == {"a": ([2.0, 3.0], 2), "b": ([5.0, 5.0], 1)}


def test_categories_of_any_number(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from docloom.operators import features as ft
    from docloom.plans.recommend import Settings, rank_corpus

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    own = [[f"d{v}" for v in range(i * 100, i * 100 + 100)] + [f"s{i % 7}", f"t{i % 11}"] for i in range(300)]  # 30,018 values
    rows = [(i, x[i].tolist(), {"form": [f"f{i % 3}", "never"], "authors": own[i], "eurovoc_descriptors": None if i == 5 else [f"e{i % 40}"]}) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, features map<string,array<string>>")
    got = {(r.query_id, r.doc_id): r.score for r in rank_corpus(docs.where("doc_id < 40").withColumnRenamed("doc_id", "query_id"), docs, Settings(top_k=5)).collect()}
    weight = {"form": 0.15, "authors": 0.10, "eurovoc_descriptors": 0.25}
    cats = [{(f, v): weight[f] for f, vs in r[2].items() for v in (vs or [])[: 1 if f == "form" else None]} for r in rows]
    length = [sum(w * w for w in c.values()) ** 0.5 for c in cats]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(40):
        s = [round(min(1, max(0, 0.49 * unit[q] @ unit[d] + 0.09 * sum(w * cats[d].get(k, 0) for k, w in cats[q].items()) / length[q] / length[d])), 6) for d in range(300)]
        want |= {(q, d): s[d] for d in sorted(range(300), key=lambda d: (-s[d], d))[:5]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    flat = docs.select("doc_id", F.explode("features").alias("feature", "vs")).select("doc_id", "feature", F.explode("vs").alias("value"))
    coded = ft.encode_dense(docs.where("doc_id = 7"), ft.vocabulary(flat)).first().vector
    assert len(coded) == 30_000 + 18 + 40 + 3 + 1 and sorted(set(coded)) == [0.0, 0.1, 0.15, 0.25] and coded.count(0.1) == 102
