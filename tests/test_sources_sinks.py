"""Readers, writers, upserts, streams."""

import json

from pyspark.sql import functions as F

from docloom.plans import index as ix
from docloom.plans import recommend as rc
from docloom.plans import reuse
from docloom.sources import readers as rd
from docloom.sources import writers as wr
from docloom.streaming import incremental as inc


def test_raw_documents_skip_broken_and_keyless(spark, tmp_path):
    d = tmp_path / "2024" / "01" / "20240105"
    d.mkdir(parents=True)
    (d / "a.json").write_text(json.dumps({"metadata": {"celex_number": "32024R1", "title": "T"}, "content": "x"}, indent=1))
    (d / "b.json").write_text(json.dumps({"metadata": {"title": "no key"}, "content": "x"}))
    (d / "c.json").write_text("{broken")
    rows = rd.read_raw_documents(spark, str(tmp_path)).collect()
    assert [r.metadata.celex_number for r in rows] == ["32024R1"]
    assert "20240105" in rows[0].file_path


def test_profile_layouts(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"user_id": "u1", "profile": {"expert_profile": {"description": "one"}, "historical_documents": ["a", "b"], "categorical_preferences": {"form": {"x": 0.5}}}}))
    (tmp_path / "p2.json").write_text(json.dumps({"client": {"id": "u2", "profile_components": {"expert_profile": {"description": "two"}, "historical_documents": ["c"]}}}))
    (tmp_path / "waste_01.json").write_text(json.dumps({"expert_description": "three"}))
    got = {r.user_id: r for r in rd.read_profiles(spark, str(tmp_path)).collect()}
    assert {k: v.expert_description for k, v in got.items()} == {"u1": "one", "u2": "two", "waste_01": "three"}
    assert got["u1"].preferences == {"form": {"x": 0.5}} and got["u2"].preferences == {} and got["waste_01"].historical_documents == []
    truth = rd.judgements_long(rd.ground_truth(rd.read_profiles(spark, str(tmp_path)))).collect()
    assert sorted((r.query_id, r.doc_id, r.rel) for r in truth) == [("u1", "a", 1.0), ("u1", "b", 1.0), ("u2", "c", 1.0)]


def test_metric_files(spark, tmp_path):
    (tmp_path / "metrics_20240102_030405.prom").write_text('# HELP x\ndocuments_processed_total{s="a"} 3\ndocuments_processed_total{s="b"} 4.5\nrequests_total 7\nodd line\n')
    from docloom.operators.monitoring import session_table

    s = rd.read_metric_samples(spark, str(tmp_path))
    assert s.count() == 3 and str(s.first().sampled_at) == "2024-01-02 03:04:05"
    assert session_table(s).first().documents_processed_total == 7.5
    assert session_table(s, "last").first().documents_processed_total == 4.5


def test_weight_groups(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"similarity": {"text": 0.7, "category": 0.3}}, indent=2))
    assert sorted(map(tuple, rd.read_weight_groups(spark, str(tmp_path / "w.json")).collect())) == [("similarity", "category", 0.3), ("similarity", "text", 0.7)]


def test_upsert_is_idempotent_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2)], "document_id int, keyword string, score double")
    new = spark.createDataFrame([(1, "b", 0.5, 1), (1, "b", 0.9, 2), (2, "c", 0.3, 1)], "document_id int, keyword string, score double, seq int")
    once = wr.upsert(base, new, ["document_id", "keyword"], ["seq"])
    twice = wr.upsert(once, new, ["document_id", "keyword"], ["seq"])
    want = [(1, "a", 0.1), (1, "b", 0.9), (2, "c", 0.3)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_store_and_load(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "2024-01-05", "x"), ("d2", "2024-02-06", "y")], "doc_id string, journal_date string, content string").withColumn("journal_date", F.to_date("journal_date"))
    wr.store_documents(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).withColumn("journal_id", F.col("journal_id").cast("string"))
    one = rd.load_document(back, "2024-02-06", "20240206", "d2")
    assert one.first().content == "y"
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    assert wr.stored_bytes(spark, str(tmp_path / "s")).first().files >= 2


def test_profile_edits(spark):
    base = spark.createDataFrame([("u", "first", ["a"], None)], "user_id string, expert_description string, historical_documents array<string>, preferences map<string,map<string,double>>")
    edits = spark.createDataFrame([("u", 1, "set_text", "second", None), ("u", 2, "add_history", "a", None), ("u", 3, "add_history", "b", None), ("u", 4, "set_preferences", None, {"form": {"x": 1.0}}), ("v", 1, "add_history", "z", None)],
                                  "user_id string, seq int, op string, text string, preferences map<string,map<string,double>>")
    got = {r.user_id: r for r in wr.apply_profile_edits(base, edits).collect()}
    assert (got["u"].expert_description, got["u"].historical_documents, got["u"].preferences) == ("second", ["a", "b"], {"form": {"x": 1.0}})
    assert got["v"].historical_documents == ["z"]
    body = json.loads(wr.profile_json(wr.apply_profile_edits(base, edits)).filter("user_id = 'u'").first().json)
    assert body["profile"]["expert_profile"]["description"] == "second"


def test_saved_results_expire(spark):
    saved = spark.createDataFrame([("a", "2024-01-02 00:00:00"), ("b", "2024-01-01 00:00:00")], "request_key string, saved_at string").withColumn("saved_at", F.to_timestamp("saved_at"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_key string")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert sorted(r[0] for r in reuse.still_to_run(asked, saved, now).collect()) == ["b", "c"]
    assert [r.request_key for r in reuse.reusable(asked, saved, now).collect()] == ["a"]


def test_state_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "doc_id int, vector array<double>").withColumn("features", F.create_map(F.lit("form"), F.array(F.lit("x"))))
    vocab = spark.createDataFrame([("form", "x", 0)], "feature string, value string, position int")
    ix.save_state(v, vocab, rc.Settings(top_k=1), str(tmp_path / "st"))
    vectors, words, s = ix.load_state(spark, str(tmp_path / "st"))
    assert s == rc.Settings(top_k=1) and words.count() == 1
    assert [(r.query_id, r.doc_id) for r in rc.recommend_by_document(vectors, s).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def brute_terms(queries, docs, k, skip_self=False):
    out = []
    for q, asked in queries.items():
        scored = []
        for d, held in docs.items():
            score = round(sum(w * held.get(t, 0.0) for t, w in asked.items()), 6)
            if any(t in held for t in asked) and not (skip_self and d == q):
                scored.append((-score, d))
        out += [(q, d, i + 1) for i, (_, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_text_recommendations_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id"), F.col("text").alias("content"))
    index = rc.text_index(docs)
    assert index.n == docs.count() and index.idf.where("idf < 0").count() == 0
    asked = docs.where("doc_id < 12").select(F.col("doc_id").alias("query_id"), F.col("content").alias("query"), F.array(F.lit("law"), F.lit("unseen")).alias("words"))
    held = {}
    for r in index.postings().collect():
        held.setdefault(r.doc_id, {})[r.term] = r.w
    for keywords in (None, "words"):
        q = rc.encode_queries(asked, index, keywords=keywords)
        queries = {r.query_id: {x.term: x.w for x in r.terms} for r in q.collect()}
        assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in queries.values() if v)
        got = rc.recommend_by_text(q, index, rc.Settings(use_features=False, top_k=3)).collect()
        assert sorted((g.query_id, g.doc_id, g["rank"]) for g in got) == brute_terms(queries, held, 3)


def test_term_search_on_random_vectors(spark):
    import random

    from docloom.operators.terms import top_k_terms

    rng = random.Random(7)
    names = [f"t{i}" for i in range(40)]

    def some(n):
        return {t: round(rng.random() ** 4, 3) for t in rng.sample(names, n)}

    docs = {i: some(rng.randint(1, 12)) for i in range(200)}
    queries = {i: some(rng.randint(1, 9)) for i in range(30)} | {500: {"absent": 1.0}, 501: {}}
    held = spark.createDataFrame([(t, d, w) for d, v in docs.items() for t, w in v.items()], "term string, doc_id long, w double")
    rows = [(q, [(t, w) for t, w in v.items()]) for q, v in queries.items()]
    asked = spark.createDataFrame(rows, "query_id long, terms array<struct<term:string,w:double>>")
    positive = lambda some: {i: {t: w for t, w in v.items() if w > 0} for i, v in some.items()}
    for skip_self in (False, True):
        got = sorted((r.query_id, r.doc_id, r["rank"]) for r in top_k_terms(asked, held, 5, skip_self).collect())
        assert got == brute_terms(positive(queries), positive(docs), 5, skip_self)


def test_user_encoder(spark):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def length(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [float(len(x)), 1.0])

    docs = spark.createDataFrame([("32024R1", "", "line one\nmore", ["k"], 1), ("32024L2", "T", None, [], 1)], "celex_number string, title string, summary string, keywords array<string>, tier int")
    rows = ix.build_vectors(docs, encoder=length).collect()
    assert len(rows) == 1 and rows[0].metadata.title == "line one" and rows[0].features["document_type"] == ["regulation"]
    assert abs(sum(x * x for x in rows[0].vector) - 1) < 1e-9


def test_stream_restart_and_replay(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "document_id int, rating int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    table = inc.KeyedTable(spark, out, ["document_id"])
    write([(1, 5), (1, 3), (2, 4)])
    inc.run_batches(inc.running_ratings(stream()), mark, table.fold).awaitTermination()
    write([(1, 1)])
    inc.run_batches(inc.running_ratings(stream()), mark, table.fold).awaitTermination()
    want = {1: (3, 3.0), 2: (1, 4.0)}
    assert {r.document_id: (r.ratings, r.avg_rating) for r in table.read().collect()} == want
    again = spark.read.parquet(f"{out}/batch=1")
    held = spark.createDataFrame(again.collect(), again.schema)
    table.fold(held, 1)
    assert {r.document_id: (r.ratings, r.avg_rating) for r in table.read().collect()} == want
    assert {r.document_id: (r.ratings, r.avg_rating) for r in table.compact(str(tmp_path / "new")).read().collect()} == want


def test_new_documents_across_restarts(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    write = lambda keys: spark.createDataFrame([(k,) for k in keys], "celex_number string").coalesce(1).write.mode("append").parquet(str(src))
    for keys in (["a", "b", "a"], ["b", "c"]):
        write(keys)
        s = spark.readStream.schema("celex_number string").parquet(str(src))
        inc.run_batches(s, mark, inc.append_new(out), "append").awaitTermination()
    assert sorted(r[0] for r in inc.read_new(spark, out, s.schema).collect()) == ["a", "b", "c"]
    inc.append_new(out)(spark.createDataFrame([("b",), ("c",)], "celex_number string"), 1)  # a repeated batch changes nothing
    assert sorted(r[0] for r in inc.read_new(spark, out, s.schema).collect()) == ["a", "b", "c"]


def test_a_lost_checkpoint_loses_no_document(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for i, keys in enumerate((["a", "b"], ["c"])):
        spark.createDataFrame([(k,) for k in keys], "celex_number string").coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema("celex_number string").parquet(str(src))
        inc.run_batches(s, str(tmp_path / f"mark{i}"), inc.append_new(out), "append").awaitTermination()
    assert sorted(r[0] for r in inc.read_new(spark, out, s.schema).collect()) == ["a", "b", "c"]


def test_bucketed_table_rewrites_what_it_touches(spark, tmp_path):
    import os

    from docloom.sources.bucketed import BucketedTable

    base = str(tmp_path / "t")
    rows = lambda some: spark.createDataFrame(some, "k long, seq int, v string")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{base}/rows") for f in fs if f.endswith(".parquet")}
    table = BucketedTable(spark, base, ["k"], rows([]).schema, 16)
    assert table.version() == -1 and table.read().count() == 0
    table.upsert(rows([(i, 0, "a") for i in range(200)]), ["seq"])
    first = files()
    batch = rows([(3, 1, "b"), (3, 2, "c"), (500, 1, "new")])
    table.upsert(batch, ["seq"])
    want = {i: "a" for i in range(200)} | {3: "c", 500: "new"}
    assert {r.k: r.v for r in table.read().collect()} == want and table.read().count() == 201
    assert first < files() and len(table.touched(batch)) <= 2
    assert sum(v == 0 for v in table.manifest().values()) == len(table.manifest()) - len(table.touched(batch))
    assert {r.k for r in table.read([table.touched(rows([(3, 0, "")]))[0]]).collect()} < set(want)
    table.upsert(batch, ["seq"])  # the same batch once more
    assert {r.k: r.v for r in table.read().collect()} == want
    # A commit that died after its rows and before its manifest is not seen, and the next takes its place.
    rows([(1, 9, "lost")]).write.parquet(f"{base}/rows/{table.version() + 1}/bucket=0")
    assert {r.k: r.v for r in table.read().collect()} == want
    table.append_new(rows([(1, 9, "not new"), (900, 1, "x"), (900, 1, "x")]))
    assert {r.k: r.v for r in table.read().collect()} == want | {900: "x"} and table.read().count() == 202
    assert {r.k: r.v for r in table.read(version=0).collect()} == {i: "a" for i in range(200)}
    version = table.version()
    table.upsert(rows([]), ["seq"])
    assert table.version() == version


def test_late_updates_do_not_win(spark, tmp_path):
    table = inc.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["seq"])
    for number, seq in enumerate((5, 3)):
        table.fold(spark.createDataFrame([("a", seq)], "k string, seq long"), number)
    assert [tuple(r) for r in table.read().collect()] == [("a", 5)]


def test_repeated_updates_keep_one_row(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, t string, u string")
    new = spark.createDataFrame([(1, "first", 1), (1, "last", 2), (3, "none", 1)], "id long, t string, seq int")
    assert sorted(map(tuple, wr.update_fields(target, new, "id", ["t"], ["seq"]).collect())) == [(1, "last", "x"), (2, "b", "y")]


def test_sample_is_exact_and_stable(spark):
    from docloom.operators.ranking import sample_by_hash

    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 990, 1).otherwise(2).alias("tier"))
    a = sample_by_hash(df, "tier", "k")
    assert {r.tier: r["count"] for r in a.groupBy("tier").count().collect()} == {1: 99, 2: 1}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sample_by_hash(df.repartition(7), "tier", "k").collect()))


def test_earliest_copy_with_a_hot_key(spark):
    from docloom.operators.corpus import duplicate_keys, keep_earliest

    rows = spark.range(300).select(F.when(F.col("id") < 200, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("celex_number"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("file_path"), F.date_sub(F.lit("2024-06-01").cast("date"), F.col("id").cast("int")).alias("stored_on"))
    kept, removed = keep_earliest(rows)
    assert kept.count() == 101 and removed.count() == 199
    assert kept.filter("celex_number = 'hot'").first().file_path == "p199"
    assert duplicate_keys(rows).count() == 200


def test_json_files_stay_small_whatever_the_copies(spark, data, tmp_path, monkeypatch):
    from suite import sources_sinks as ss
    from suite.base import Tables

    text = 'one "text"\nthat all share ' + "x" * 20_000
    one = F.struct(F.struct(F.concat(F.lit("3"), F.col("id").cast("string")).alias("celex_number"), F.lit("f").alias("form"), F.struct(F.lit("05/01/2024").alias("Date of document")).alias("dates")).alias("metadata"), F.lit(text).alias("content"))
    monkeypatch.setattr(ss, "raw_documents", lambda t: spark.range(0, 400, 1, 3).select(one.alias("d")).select("d.*"))
    monkeypatch.setattr(ss, "shared_dir", lambda spark, name: str(tmp_path / name))
    got = ss.json_documents(Tables(spark, data)).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"3{i}", "f", "2024-01-05", len(text)) for i in range(400))
    sizes = [f.stat().st_size for f in tmp_path.rglob("*.txt")]
    assert max(sizes) <= 1.1 * (1 << 20) and len(sizes) >= 8
