import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import scores as sc
from docloom.operators import batches as bt
from docloom.operators import categories as cg

FEATURES = "map<string,array<string>>"


def match(q, d):
    total = weight = 0.0
    for name, w in sc.FEATURE_WEIGHTS.items():
        if q.get(name) is None or d.get(name) is None:
            continue
        a, b = ([x for x in v if x is not None] for v in (q[name], d[name]))
        if name in sc.MULTI_VALUED:
            union = set(a) | set(b)
            total += w * (len(set(a) & set(b)) / len(union) if union else 0.0)
        else:
            total += w * bool(a and b and a[0] == b[0])
        weight += w
    return round(total / weight, 9) if weight else 0.0


def some_features(rng):
    out = {}
    for name in ("form", "subject_matters", "authors", "other"):
        if rng.random() < 0.7:
            out[name] = rng.sample("abcdefg", rng.randint(0, 3))
    return out or None


def test_category_search_equals_scoring_every_pair(spark):
    rng = random.Random(4)
    docs = [(i, some_features(rng)) for i in range(250)] + [(1000 + i, {"form": ["a"], "subject_matters": ["a", "b"]}) for i in range(100)] + [(2000, {}), (2001, None)]
    queries = [(i, some_features(rng)) for i in range(25)] + [(25, {"form": ["absent"]}), (26, {}), (27, docs[0][1]), (28, docs[0][1])]
    want = []
    for q, asked in queries:
        best = sorted((-s, d) for d, own in docs if (s := match(asked or {}, own or {})) > 0)[:7]
        want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(best)]
    q = spark.createDataFrame(queries, f"query_id long, features {FEATURES}")
    d = spark.createDataFrame(docs, f"doc_id long, features {FEATURES}").repartition(3)
    got = sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in cg.top_k_categories(q, d, 7).collect())
    assert got == sorted(want)
    assert cg.top_k_categories(q.limit(0), d, 7).count() == 0


def test_batches_are_full_ordered_and_of_one_key(spark):
    def seen(rows: pa.Table) -> pa.Table:
        keys = set(rows["k"].to_pylist())
        return pa.table({"k": pa.array([",".join(sorted(keys))]), "n": pa.array([len(rows)], pa.int64()), "first": pa.array([rows["v"][0].as_py()], pa.int64()), "last": pa.array([rows["v"][-1].as_py()], pa.int64())})

    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(7)], "k string, v long").repartition(4)
    returns = "k string, n long, first long, last long"
    got = sorted(tuple(r) for r in bt.process_in_batches(df, seen, 10, returns, ["k"], ["v"]).collect())
    assert got == [("a", 5, 20, 24), ("a", 10, 0, 9), ("a", 10, 10, 19), ("b", 7, 0, 6)]
    assert bt.process_in_batches(df.limit(0), seen, 10, returns, ["k"]).collect() == []
    spark.udtf.register("in_tens", bt.batch_function(seen, 10, returns))
    df.createOrReplaceTempView("batch_rows")
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM in_tens(TABLE(batch_rows) PARTITION BY k ORDER BY v)").collect()) == got
    with pytest.raises(ValueError):
        bt.process_in_batches(df, seen, 10, returns)
    with pytest.raises(ValueError):
        bt.batch_function(seen, 0, returns)


def test_models_are_loaded_once_for_many_batches(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts: [f"{len(texts)}:{x}" for x in texts]

    df = spark.range(100).coalesce(1).select("id", F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("t"))
    got = df.select("id", bt.summariser_udf(load, 30)("t").alias("s")).collect()
    assert loads.value == 1
    assert [r.id for r in got if r.s is None] == list(range(0, 100, 10))
    assert all(r.s.endswith(f":{r.id}") and int(r.s.split(":")[0]) <= 30 for r in got if r.s)
    vec = df.select(bt.encoder_udf(lambda: lambda texts: [[len(x), 2] for x in texts])("t").alias("v")).collect()
    assert vec[1].v == [1.0, 2.0] and vec[0].v is None
    bad = df.select(bt.summariser_udf(lambda: lambda texts: texts[:1])("t").alias("s"))
    with pytest.raises(Exception, match="results for"):
        bad.collect()


def test_a_feature_of_many_values_is_numbered_in_ranges(spark):
    from docloom.operators import features as ft

    n = 200_000
    many = spark.range(n).select(F.lit("author").alias("feature"), F.format_string("a%07d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("value"))
    few = spark.createDataFrame([("form", "b"), ("form", "a"), ("form", "b"), ("zone", "x")], "feature string, value string")
    vocab = ft.vocabulary(many.unionByName(few).repartition(6))
    assert vocab.where("feature = 'author' AND value <> format_string('a%07d', position)").count() == 0
    assert {r.feature: r.dims for r in ft.dimensions(vocab).collect()} == {"author": n, "form": 2, "zone": 1}
    assert {(r.value, r.position) for r in vocab.where("feature <> 'author'").collect()} == {("a", 0), ("b", 1), ("x", 0)}
    rows = [(1, {"author": ["a0000005"], "form": ["b", "a"], "zone": ["x"]}), (2, {"form": ["never"]}), (3, None)]
    df = spark.createDataFrame(rows, f"doc_id long, features {FEATURES}")
    got = {r.doc_id: (r.size, r.indices, r.cells) for r in ft.encode_vectors(df, vocab, weights={"author": 0.5, "form": 0.25}, multi=("author",)).collect()}
    assert got == {1: (n + 3, [5, n + 1, n + 2], [0.5, 0.25, 1.0]), 2: (n + 3, [], []), 3: (n + 3, [], [])}
