"""Vectors, maps, scores and top-k."""

from pyspark.sql import functions as F

from docloom.functions import maps as mp
from docloom.functions import scores as sc
from docloom.functions import vectors as vc
from docloom.operators import features as ft
from docloom.operators import similarity as sm
from docloom.operators.ranking import rank_results

from .base import Tables, query

def queries_of(t: Tables):
    return t.vecs.withColumnRenamed("doc_id", "query_id")


def sims10(t: Tables, k: int = 10):
    return sm.top_k(queries_of(t), t.vecs, k, skip_self=True)


@query("top_k_similar", "TOP1 JN12 WIN5 VEC2", "SELECT query_id, doc_id, score, rank FROM top10")
def top_k_similar(t: Tables):
    return sims10(t)


@query("top_k_in_blocks", "TOP1 JN12", "SELECT query_id, doc_id, score, rank FROM top10")
def top_k_in_blocks(t: Tables):
    """The same search with query blocks of 32 KB, so that it takes many cells."""
    from docloom.operators.similarity import top_k

    v = t.vecs.select("doc_id", "vector")
    return top_k(v.withColumnRenamed("doc_id", "query_id"), v, 10, skip_self=True, query_bytes=32 << 10, doc_groups=3)


@query("vector_norms", "VEC1", """SELECT doc_id, round(sqrt(list_dot_product(vector, vector)), 6) AS norm,
    round(vector[1] / sqrt(list_dot_product(vector, vector)), 6) AS first_cell FROM vecs""")
def vector_norms(t: Tables):
    u = vc.unit(F.col("vector"))
    return t.vecs.select("doc_id", F.round(vc.norm(F.col("vector")), 6).alias("norm"), F.round(F.get(u, 0), 6).alias("first_cell"))


@query("cosine_to_label_mean", "VEC2 VEC4", """WITH m AS (SELECT label, list(x ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x) AS x FROM
    (SELECT label, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM vecs) GROUP BY ALL) GROUP BY label)
    SELECT doc_id, label, round(list_cosine_similarity(vector, mean), 6) AS score FROM vecs JOIN m USING (label)""")
def cosine_to_label_mean(t: Tables):
    means = sm.mean_vectors(t.vecs, "label").select("label", F.col("vector").alias("mean"))
    return t.vecs.join(means, "label").select("doc_id", "label", F.round(vc.cosine(F.col("vector"), F.col("mean")), 6).alias("score"))


@query("mean_vector_cells", "VEC4", """SELECT label, pos, round(avg(x), 6) AS cell FROM
    (SELECT label, unnest(vector) AS x, unnest(range(len(vector)))::INT AS pos FROM vecs) GROUP BY ALL""")
def mean_vector_cells(t: Tables):
    return sm.mean_vectors(t.vecs, "label").select("label", F.posexplode("vector").alias("pos", "cell")).withColumn("cell", F.round("cell", 6))


@query("blended_vectors", "VEC3 VEC5", """SELECT doc_id, pos, round((0.75::DOUBLE * x + 0.25::DOUBLE * y)
      / sqrt(sum((0.75::DOUBLE * x + 0.25::DOUBLE * y) ** 2) OVER (PARTITION BY doc_id)), 6) AS cell FROM (
      SELECT doc_id, unnest(range(len(vector)))::INT AS pos, unnest(vector) AS x, unnest(list_reverse(vector)) AS y FROM vecs)""")
def blended_vectors(t: Tables):
    # Summary and keyword vectors: the vector and its reverse.
    v = vc.blend(F.col("vector"), F.reverse("vector"), F.lit(5), fixed_summary_weight=0.75)
    return t.vecs.select("doc_id", F.posexplode(v).alias("pos", "cell")).withColumn("cell", F.round("cell", 6))


@query("keyword_blend_weight", "VEC5", """SELECT document_id, n, round(greatest(0.1, least(0.4, 0.1 + 0.01667::DOUBLE * (n - 2)))::DOUBLE, 6) AS wk
    FROM (SELECT document_id, count(*)::INT AS n FROM kws GROUP BY 1)""")
def keyword_blend_weight(t: Tables):
    n = t.kws.groupBy("document_id").agg(F.count("*").cast("int").alias("n"))
    return n.withColumn("wk", F.round(vc.keyword_weight(F.col("n")), 6))


@query("text_vector_cells", "VEC6", """WITH t AS (SELECT document_id, ('0x' || substr(md5(tok), 1, 7))::BIGINT % 262144 AS b, tok
      FROM (SELECT document_id, unnest(toks) AS tok FROM toks)),
    idf AS (SELECT b, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (count(DISTINCT document_id) + 1)) AS idf FROM t GROUP BY b),
    w AS (SELECT document_id, b, count(*) * any_value(idf) AS w FROM t JOIN idf USING (b) GROUP BY document_id, b)
    SELECT document_id, b, round(w / sqrt(sum(w * w) OVER (PARTITION BY document_id)), 6) AS w FROM w""")
def text_vector_cells(t: Tables):
    from docloom.functions import text as tx
    from docloom.operators.extractive import corpus_idf

    idf = corpus_idf(t.texts, hash_name="md5")
    rows = ft.text_vector_rows(t.texts.select("document_id", "content"), "document_id", tx.tokens(F.col("content")), idf, hash_name="md5")
    return rows.select("document_id", "b", F.round("w", 6).alias("w"))


@query("encoded_features", "VEC7", """SELECT doc_id, pos, cell FROM (SELECT doc_id, unnest(list_concat(
      list_transform(range(10), lambda l: CASE WHEN l = label THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END),
      list_transform(range(3), lambda g: CASE WHEN g = grp THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END),
      list_transform(range(10), lambda l: CASE WHEN l = label THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END))) AS cell,
      unnest(range(23))::INT AS pos FROM vecs)""")
def encoded_features(t: Tables):
    rows = t.vecs.select(F.col("doc_id"), F.explode("features").alias("feature", "values")).select("doc_id", "feature", F.explode("values").alias("value"))
    coded = ft.encode_dense(t.vecs.select("doc_id", "features"), ft.vocabulary(rows), out="v")
    return coded.select("doc_id", F.posexplode("v").alias("pos", "cell"))


@query("encoded_sparse_features", "VEC7 AGG27", """SELECT doc_id, 23::BIGINT AS size, label || ',' || (10 + grp) || ',' || (13 + label) AS indices, '0.15,0.25,0.25' AS cells FROM vecs""")
def encoded_sparse_features(t: Tables):
    coded = ft.encode_vectors(t.vecs.select("doc_id", "features"), ft.vocabulary(feature_rows(t)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return coded.select("doc_id", F.col("size").cast("long").alias("size"), text("indices").alias("indices"), text("cells").alias("cells"))


def feature_rows(t: Tables):
    return t.vecs.select("doc_id", F.explode("features").alias("feature", "values")).select("doc_id", "feature", F.explode("values").alias("value"))


FEATURE_ROWS_SQL = """(SELECT doc_id, 'form' AS feature, 'l' || label AS value FROM vecs UNION ALL
    SELECT doc_id, 'subject_matters', 'l' || label FROM vecs UNION ALL SELECT doc_id, 'subject_matters', 'g' || grp FROM vecs)"""


@query("sparse_features", "VEC7 VEC9", f"""WITH f AS {FEATURE_ROWS_SQL}, v AS (SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::INT AS position
      FROM (SELECT DISTINCT feature, value FROM f))
    SELECT doc_id, feature, position, CASE feature WHEN 'form' THEN 0.375::DOUBLE ELSE 0.625::DOUBLE END AS weight FROM f JOIN v USING (feature, value)""")
def sparse_features(t: Tables):
    rows = feature_rows(t)
    weights = vc.check_weights({"form": 0.15, "subject_matters": 0.25, "authors": -1.0})
    return ft.encode_sparse(rows, ft.vocabulary(rows), weights)


@query("feature_dimensions", "VEC8", f"SELECT feature, count(DISTINCT value) AS dims FROM {FEATURE_ROWS_SQL} GROUP BY 1")
def feature_dimensions(t: Tables):
    return ft.dimensions(ft.vocabulary(feature_rows(t)))


@query("merged_features", "MAP1", """SELECT user_id, 'form=l' || label || ';role=q' || (user_id % 4) || ';subject_matters=w' || (user_id % 5) AS merged FROM experts""")
def merged_features(t: Tables):
    one = lambda p, m: F.concat(F.lit(p), F.pmod("user_id", F.lit(m)).cast("string"))
    base = F.transform_values("features", lambda k, v: F.get(v, 0))
    winner = F.create_map(F.lit("subject_matters"), one("w", 5), F.lit("role"), one("q", 4))
    return t.experts.select("user_id", mp.as_text(mp.merge(base, winner)).alias("merged"))


@query("kept_features", "MAP2", "SELECT user_id, 'form=l' || label AS kept FROM experts")
def kept_features(t: Tables):
    base = F.transform_values("features", lambda k, v: F.get(v, 0))
    return t.experts.select("user_id", mp.as_text(mp.keep_keys(base, "form", "authors")).alias("kept"))


@query("features_from_json", "MAP3", """SELECT event_id, (props->>'k')::INT AS k FROM events""")
def features_from_json(t: Tables):
    wrapped = F.regexp_replace("props", r"(\d+)", r'["$1"]')
    parsed = mp.features_from_json(wrapped)
    return t.raw("events").select("event_id", F.get(F.try_element_at(parsed, F.lit("k")), 0).cast("int").alias("k"))


# -- pair scores on the candidates of every document ------------------------------------------------------------

def pair_rows(t: Tables, k: int = 20):
    found = sm.top_k(queries_of(t), t.vecs, k, skip_self=True).withColumnRenamed("score", "text_score").drop("rank")
    d = t.vecs.select("doc_id", F.col("features").alias("_doc"), "date")
    q = queries_of(t).select("query_id", F.col("features").alias("_query"))
    return found.join(d, "doc_id").join(q, "query_id")


def match():
    return sc.feature_match(F.col("_query"), F.col("_doc"), sc.FEATURE_WEIGHTS)


@query("feature_match_scores", "SIM4", "SELECT query_id, doc_id, round(category_score, 6) AS category_score FROM comps")
def feature_match_scores(t: Tables):
    return pair_rows(t).select("query_id", "doc_id", F.round(match(), 6).alias("category_score"))


@query("pair_scores", "SIM1", """SELECT query_id, doc_id, round(0.7::DOUBLE * text_score + 0.3::DOUBLE * (0.0225::DOUBLE * same_label + 0.0625::DOUBLE * shared) / 0.1475::DOUBLE, 9) AS score FROM cand20""")
def pair_scores(t: Tables):
    # The category vectors of a document are label (0.15) and label, group (0.25 each): cosine of the encodings.
    unit = lambda c: ft.scaled_to(ft.categories(F.col(c)), 1.0)
    cat = ft.shared_weight(unit("_query"), unit("_doc"))
    return pair_rows(t).select("query_id", "doc_id", F.round(sc.pair_score(F.col("text_score"), cat), 9).alias("score"))


@query("weighted_dot_scores", "SIM2", """SELECT query_id, doc_id, round(0.15::DOUBLE * same_label + 0.25::DOUBLE * shared, 6) AS score FROM cand20""")
def weighted_dot_scores(t: Tables):
    plain = {"form": 1.0, "subject_matters": 1.0}
    score = ft.shared_weight(ft.categories(F.col("_query")), ft.categories(F.col("_doc"), plain))
    return pair_rows(t).select("query_id", "doc_id", F.round(score, 6).alias("score"))


@query("index_scores", "SIM3 REC6", """SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(greatest(0.0, least(1.0, 0.49::DOUBLE * list_s + 0.09::DOUBLE * (0.0225::DOUBLE * same_label + 0.0625::DOUBLE * shared) / 0.1475::DOUBLE)), 6) AS score FROM (
      SELECT q.doc_id AS query_id, d.doc_id, list_cosine_similarity(q.vector, d.vector) AS list_s, (q.label = d.label)::INT AS same_label,
        ((q.label = d.label)::INT + (q.grp = d.grp)::INT) AS shared FROM vecs q, vecs d)) WHERE score >= 0.2) WHERE rank <= 10""")
def index_scores(t: Tables):
    from docloom.plans.recommend import Settings, rank_corpus

    out = rank_corpus(queries_of(t), t.vecs, Settings(min_similarity=0.2))
    return out.select("query_id", "doc_id", "score", "rank")


@query("combined_scores", "SIM5", "SELECT query_id, doc_id, round(0.7::DOUBLE * text_score + 0.3::DOUBLE * category_score, 9) AS score FROM comps")
def combined_scores(t: Tables):
    return pair_rows(t).select("query_id", "doc_id", F.round(sc.combined(F.col("text_score"), match()), 9).alias("score"))


@query("presence_bonus_scores", "SIM6", """SELECT query_id, doc_id, round(text_score + CASE WHEN doc_id % 2 <> 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 <> 0 THEN 0.05::DOUBLE ELSE 0 END, 6) AS score FROM cand20""")
def presence_bonus_scores(t: Tables):
    pref = F.create_map(F.lit("form"), F.lit(0.1), F.lit("subject_matters"), F.lit(0.05), F.lit("authors"), F.lit(0.2))
    # Every second document has no form, every third no subjects.
    lacks = lambda k, name, n: (k == name) & (F.pmod("doc_id", F.lit(n)) == 0)
    held = F.map_filter("_doc", lambda k, _: ~lacks(k, "form", 2) & ~lacks(k, "subject_matters", 3))
    return pair_rows(t).select("query_id", "doc_id", F.round(F.col("text_score") + sc.presence_bonus(held, pref), 6).alias("score"))


@query("value_bonus_scores", "SIM7", """SELECT query_id, doc_id, round(text_score + (CASE WHEN l = 3 THEN 0.2::DOUBLE ELSE 0 END)
    + (CASE WHEN l = 3 THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN g = 1 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score
    FROM (SELECT c.*, v.label AS l, v.grp AS g FROM cand20 c JOIN vecs v USING (doc_id))""")
def value_bonus_scores(t: Tables):
    inner = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    pref = F.create_map(F.lit("form"), inner("l3", 0.2), F.lit("subject_matters"), inner("l3", 0.05, "g1", 0.1))
    rows = pair_rows(t).withColumn("pref", pref)
    return rows.select("query_id", "doc_id", F.round(F.col("text_score") + sc.value_bonus(F.col("_doc"), F.col("pref")), 6).alias("score"))


def _recency_query(kind: str, sql_score: str, ids: str):
    @query(f"recency_{kind}", ids, f"""SELECT query_id, doc_id, round(CASE WHEN date IS NULL {'OR date > DATE $$2020-06-30$$' if kind == 'exponential' else ''} THEN text_score
        ELSE 0.7::DOUBLE * text_score + 0.3::DOUBLE * ({sql_score}) END, 9) AS score FROM cand20""".replace("$$", "'"))
    def run(t: Tables):
        ref = F.lit("2020-06-30").cast("date")
        return pair_rows(t).select("query_id", "doc_id", F.round(sc.recency_boost(F.col("text_score"), F.col("date"), ref, 0.3, kind), 9).alias("score"))


_DAYS = "(DATE '2020-06-30' - date)::DOUBLE"
_recency_query("exponential", f"exp(-{_DAYS} / 730)", "SIM8")
_recency_query("sqrt", f"CASE WHEN {_DAYS} >= 0 THEN 1 - sqrt(least({_DAYS}, 3650) / 3650) ELSE 0.5::DOUBLE END", "SIM9")
_recency_query("linear", f"greatest(0, 1 - abs({_DAYS}) / 3650)", "SIM10")


@query("two_stage_results", "TOP2", """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, round(0.7::DOUBLE * text_score + 0.3::DOUBLE * category_score, 9) AS score FROM comps)) WHERE rank <= 10""")
def two_stage_results(t: Tables):
    rows = pair_rows(t, 20)
    scored = rows.select("query_id", "doc_id", F.round(sc.combined(F.col("text_score"), match()), 9).alias("score"))
    return rank_results(scored, 10)


@query("ranked_corpus_recent", "REC6 SIM9", """WITH r AS (SELECT query_id, doc_id, round(greatest(0.0, least(1.0, 0.49::DOUBLE * s + 0.09::DOUBLE * (0.0225::DOUBLE * same_label + 0.0625::DOUBLE * shared) / 0.1475::DOUBLE)), 6) AS score, date FROM (
      SELECT q.doc_id AS query_id, d.doc_id, d.date, list_cosine_similarity(q.vector, d.vector) AS s, (q.label = d.label)::INT AS same_label, ((q.label = d.label)::INT + (q.grp = d.grp)::INT) AS shared FROM vecs q, vecs d)),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS crank FROM r) WHERE crank <= 10)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(CASE WHEN date IS NULL THEN score ELSE 0.7::DOUBLE * score
      + 0.3::DOUBLE * CASE WHEN DATE '2020-06-30' >= date THEN 1 - sqrt(least((DATE '2020-06-30' - date)::DOUBLE, 3650) / 3650) ELSE 0.5::DOUBLE END END, 9) AS score FROM c)""")
def ranked_corpus_recent(t: Tables):
    from docloom.plans.recommend import Settings, rank_corpus

    s = Settings(recency_weight=0.3, recency_kind="sqrt", reference_date="2020-06-30")
    return rank_corpus(queries_of(t), t.vecs, s).select("query_id", "doc_id", "score", "rank")
