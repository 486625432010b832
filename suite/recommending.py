"""Recommendation jobs: by vector, by document, for profiles, for text."""

from pyspark.sql import functions as F

from docloom.functions import keys as ky
from docloom.functions import maps as mp
from docloom.functions import text as tx
from docloom.functions import vectors as vc
from docloom.operators import feedback as fb
from docloom.operators import similarity as sm
from docloom.plans import index as ix
from docloom.plans import recommend as rc
from docloom.plans import sweep as sw
from docloom.sources import readers as rd

from .base import Tables, query, tokens_sql
from .scoring import queries_of, sims10

REF = "2020-06-30"
_BOOST = """round(CASE WHEN date IS NULL OR date > DATE '2020-06-30' THEN {0} ELSE 0.8::DOUBLE * ({0}) + 0.2::DOUBLE * exp(-(DATE '2020-06-30' - date)::DOUBLE / 730) END, 9)"""
_COMBINED = "(0.7::DOUBLE * text_score + 0.3::DOUBLE * category_score)"


def _rank(sql: str, k: int = 10, keys: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) AS rank FROM ({sql})) WHERE rank <= {k}"


@query("recommend_by_document", "REC2", _rank(f"SELECT query_id, doc_id, {_BOOST.format(_COMBINED)} AS score FROM comps"))
def recommend_by_document(t: Tables):
    s = rc.Settings(recency_weight=0.2, reference_date=REF)
    return rc.recommend_by_document(t.vecs, s).select("query_id", "doc_id", "score", "rank")


# Queries by vector: the mean of every label asks, with the label as its feature, over documents of one group.
@query("recommend_filtered", "REC1 PRJ25", """WITH m AS (SELECT label, list(x ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM vecs) GROUP BY ALL) GROUP BY label),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, doc_id) AS crank FROM (SELECT m.label AS query_id, doc_id, round(list_cosine_similarity(mean, vector), 6) AS text_score, (m.label = v.label)::INT AS same, date FROM m, vecs v WHERE grp = 1)) WHERE crank <= 20)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(0.7::DOUBLE * text_score + 0.3::DOUBLE * same, 9) AS score FROM c)) WHERE rank <= 10""")
def recommend_filtered(t: Tables):
    label = F.concat(F.lit("l"), F.col("label").cast("string"))
    q = sm.mean_vectors(t.vecs, "label").select(F.col("label").alias("query_id"), "vector", F.create_map(F.lit("form"), F.array(label)).alias("features"))
    docs = rc.metadata_filter(t.vecs.withColumn("group", F.pmod("doc_id", F.lit(3)).cast("string")), {"group": "1"})
    return rc.recommend(q, docs).select("query_id", "doc_id", "score", "rank")


_PROFILE_SIMS = """SELECT p.user_id AS query_id, v.doc_id, round(list_cosine_similarity(p.vector, v.vector), 6) AS text_score, (p.label = v.label)::INT AS same_label, ((p.label = v.label)::INT + (p.grp = v.grp)::INT) AS shared FROM {0} p, vecs v"""


def _profile_sql(source: str) -> str:
    return _rank(f"""SELECT query_id, doc_id, round(0.7::DOUBLE * text_score + 0.3::DOUBLE * (0.15::DOUBLE * same_label + 0.25::DOUBLE * (shared / (4.0::DOUBLE - shared))) / 0.4::DOUBLE, 9) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, doc_id) AS crank FROM ({_PROFILE_SIMS.format(source)})) WHERE crank <= 20""")


def profiles(t: Tables):
    v = rc.profile_vectors(t.experts, t.history, t.vecs)
    return v.join(t.experts.select("user_id", "features"), "user_id")


@query("profile_vectors", "REC3 VEC10", """SELECT user_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 6) AS cell FROM (SELECT user_id, unnest(vector) AS x, unnest(range(len(vector)))::INT AS pos FROM profvec)""")
def profile_vectors(t: Tables):
    we, wh = vc.rescale(2.0, 2.0)
    return rc.profile_vectors(t.experts, t.history, t.vecs, we, wh).select("user_id", F.posexplode("vector").alias("pos", "cell")).withColumn("cell", F.round("cell", 6))


@query("recommend_for_profiles", "REC4", _profile_sql("profvec"))
def recommend_for_profiles(t: Tables):
    return rc.recommend_for_profiles(profiles(t), t.vecs).select("query_id", "doc_id", "score", "rank")


@query("recommend_personalised_queries", "REC4 MAP1", _profile_sql("""(SELECT e.user_id, q.label, q.grp, list_transform(list_zip(list_transform(e.vector, lambda x: x / sqrt(list_dot_product(e.vector, e.vector))),
      list_transform(q.vector, lambda x: x / sqrt(list_dot_product(q.vector, q.vector)))), lambda z: 0.5::DOUBLE * z[1] + 0.5::DOUBLE * z[2]) AS vector FROM profvec e JOIN vecs q ON q.doc_id = (e.user_id * 3) % (SELECT count(*) FROM embeddings))"""))
def recommend_personalised_queries(t: Tables):
    users = t.experts.select("user_id", F.pmod(F.col("user_id") * 3, F.lit(t.n_vectors)).alias("doc_id"))
    q = users.join(t.vecs.select("doc_id", vc.unit(F.col("vector")).alias("vector"), "features"), "doc_id").select(
        "user_id", F.col("user_id").alias("query_id"), "vector", "features")
    return rc.recommend_for_profiles(profiles(t), t.vecs, queries=q).select("query_id", "doc_id", "score", "rank")


@query("recommend_categorical", "REC5", _rank("""SELECT user_id AS query_id, doc_id, round((0.15::DOUBLE * (p.label = v.label)::INT + 0.25::DOUBLE * (s / (4.0::DOUBLE - s))) / 0.4::DOUBLE, 9) AS score
    FROM (SELECT p.*, v.doc_id, v.label AS l, ((p.label = v.label)::INT + (p.grp = v.grp)::INT) AS s FROM experts p, vecs v) p JOIN vecs v USING (doc_id) WHERE s > 0"""))
def recommend_categorical(t: Tables):
    """Every user asks with the preferred categories alone."""
    return rc.recommend_categorical(t.experts.select(F.col("user_id").alias("query_id"), "features"), t.vecs)


@query("recommend_expert_mode", "REC5", _profile_sql("experts"))
def recommend_expert_mode(t: Tables):
    v = rc.profile_vectors(t.experts, t.history, t.vecs, *rc.PROFILE_MODES["expert"]).join(t.experts.select("user_id", "features"), "user_id")
    return rc.recommend_for_profiles(v, t.vecs).select("query_id", "doc_id", "score", "rank")


@query("recommend_with_preferences", "REC2 SIM7", _rank("""SELECT query_id, doc_id, round(0.7::DOUBLE * text_score + 0.3::DOUBLE * category_score + CASE WHEN l = 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN g = 1 THEN 0.1::DOUBLE ELSE 0 END, 9) AS score
    FROM (SELECT c.*, v.label AS l, v.grp AS g FROM comps c JOIN vecs v USING (doc_id))"""))
def recommend_with_preferences(t: Tables):
    inner = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    pref = F.create_map(F.lit("form"), inner("l3", 0.2), F.lit("subject_matters"), inner("g1", 0.1))
    return rc.recommend_by_document(t.vecs.withColumn("preferences", pref)).select("query_id", "doc_id", "score", "rank")


@query("feedback_boosted", "SIM11", """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT query_id, doc_id, round(t.score * (1 + coalesce((a - 1) / 4, 0) * 0.2::DOUBLE), 12) AS score FROM top10 t LEFT JOIN (SELECT document_id AS doc_id, avg(rating) AS a FROM feedback GROUP BY 1) r USING (doc_id)))""")
def feedback_boosted(t: Tables):
    return fb.boost(sims10(t), t.feedback).select("query_id", "doc_id", "score", "rank")


@query("feedback_boosted_per_user", "SIM11", """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT query_id, doc_id, round(t.score * (1 + coalesce((a - 1) / 4, 0) * 0.2::DOUBLE), 12) AS score FROM top10 t LEFT JOIN (SELECT document_id AS doc_id, user_id, avg(rating) AS a FROM feedback GROUP BY 1, 2) r ON r.doc_id = t.doc_id AND r.user_id = t.query_id % 150))""".replace("query_id, doc_id, round", "query_id, t.doc_id, round"))
def feedback_boosted_per_user(t: Tables):
    asked = sims10(t).withColumn("user_id", F.pmod("query_id", F.lit(150)))
    return fb.boost(asked, t.feedback, per_user=True).select("query_id", "doc_id", "score", "rank")


@query("reweighted_results", "REC9 VEC10", _rank("SELECT query_id, doc_id, round(0.4::DOUBLE * text_score + 0.6::DOUBLE * category_score, 9) AS score FROM comps"))
def reweighted_results(t: Tables):
    tw, cw = vc.rescale(2.0, 3.0)
    s = rc.with_weights(rc.Settings(), text_weight=tw, category_weight=cw)
    return rc.recommend_by_document(t.vecs, s).select("query_id", "doc_id", "score", "rank")


# -- text to vectors to results ---------------------------------------------------------------------------------

def _unit_sql(rows: str, key: str) -> str:
    """Rows (key, tok, w) scaled to length 1 for each key."""
    return f"(SELECT {key}, tok, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {rows})"


def _tfidf_sql(rows: str, key: str) -> str:
    """Unit tf-idf rows (key, tok, w) of token rows (key, tok); ``idf`` and ``n`` stand before."""
    return _unit_sql(f"(SELECT {key}, tok, tf * coalesce(idf, (SELECT ln(n + 1) FROM n)) AS w FROM (SELECT {key}, tok, count(*) AS tf FROM {rows} GROUP BY ALL) LEFT JOIN idf USING (tok))", key)


def _blend_sql(text: str, keys: str, counts: str, key: str) -> str:
    """Both vectors of a key as one; ``counts`` has the number k of its keywords. Without keywords the text's stays."""
    wk = "greatest(0.1::DOUBLE, least(0.4::DOUBLE, 0.1::DOUBLE + 0.01667::DOUBLE * (k - 2)))"
    mixed = f"""(SELECT {key}, tok, sum(w) AS w FROM (SELECT {key}, tok, CASE WHEN k > 0 THEN (1 - {wk}) * w ELSE w END AS w FROM {text} JOIN {counts} USING ({key})
        UNION ALL SELECT {key}, tok, {wk} * w FROM {keys} JOIN {counts} USING ({key}) WHERE k > 0) GROUP BY ALL)"""
    return _unit_sql(mixed, key)


_IDF_SQL = """n AS (SELECT count(*)::DOUBLE AS n FROM {source}), idf AS (SELECT tok, ln((SELECT n + 1 FROM n) / (count(*) + 1)) AS idf FROM (SELECT DISTINCT {key}, tok FROM {rows}) GROUP BY tok)"""


@query("recommend_by_text", "REC1", f"""WITH dt AS (SELECT document_id AS doc_id, unnest(toks) AS tok FROM toks), {_IDF_SQL.format(source="docs", key="doc_id", rows="dt")},
    dv AS MATERIALIZED {_tfidf_sql("dt", "doc_id")}, q AS (SELECT item_id AS query_id, {tokens_sql('text')} AS qt FROM benchmark),
    k AS (SELECT query_id, least(5, len(qt)) AS k FROM q), qv AS MATERIALIZED {_blend_sql(_tfidf_sql("(SELECT query_id, unnest(qt) AS tok FROM q)", "query_id"), _tfidf_sql("(SELECT query_id, unnest(qt[1:5]) AS tok FROM q)", "query_id"), "k", "query_id")},
    s AS (SELECT query_id, doc_id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (tok) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def recommend_by_text(t: Tables):
    """Every benchmark text asks the whole document table, with keywords and combined vectors."""
    index = rc.text_index(t.texts.select(F.col("document_id").alias("doc_id"), "content"))
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.slice(tx.tokens(F.col("text")), 1, 5).alias("keywords"))
    asked = rc.encode_queries(q, index, keywords="keywords")
    return rc.recommend_by_text(asked, index, rc.Settings(use_features=False)).select("query_id", "doc_id", "score", "rank")


def bundles(t: Tables):
    from docloom.operators import corpus as cp

    kw = cp.top_keywords(t.kws)
    empty = F.array().cast("array<string>")
    docs = t.summarised.withColumn("tier", tx.tier(F.col("total_words"))).join(kw, "document_id", "left")
    return docs.select("celex_number", "title", "summary", F.coalesce("keywords", empty).alias("keywords"), "tier")


@query("vector_rows", "REC7", """SELECT celex_number AS doc_id, CASE substr(celex_number, 6, 1) WHEN 'R' THEN 'regulation' WHEN 'L' THEN 'directive' WHEN 'D' THEN 'decision' WHEN 'Q' THEN 'recommendation' ELSE 'other' END AS document_type,
    least(20, coalesce(k, 0))::INT AS num_keywords FROM summarised LEFT JOIN (SELECT document_id, count(*) AS k FROM kws GROUP BY 1) USING (document_id) WHERE trim(coalesce(summary, '')) <> ''""")
def vector_rows(t: Tables):
    return ix.build_vectors(bundles(t)).select("doc_id", "metadata.document_type", "metadata.num_keywords")


@query("vector_terms", "REC7 VEC3", f"""WITH kw AS (SELECT document_id, list(keyword ORDER BY rn) AS l FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, keyword) AS rn FROM kws) WHERE rn <= 20 GROUP BY 1),
    b AS (SELECT celex_number AS doc_id, {tokens_sql('summary')} AS st, coalesce(l, []) AS l FROM summarised LEFT JOIN kw USING (document_id) WHERE trim(coalesce(summary, '')) <> ''),
    stoks AS (SELECT doc_id, unnest(st) AS tok FROM b), {_IDF_SQL.format(source="b", key="doc_id", rows="stoks")}, k AS (SELECT doc_id, len(l) AS k FROM b),
    v AS {_blend_sql(_tfidf_sql("stoks", "doc_id"), _tfidf_sql("(SELECT doc_id, unnest(" + tokens_sql("array_to_string(l, ' ')") + ") AS tok FROM b)", "doc_id"), "k", "doc_id")}
    SELECT doc_id, tok AS term, round(w, 6) AS w FROM v""")
def vector_terms(t: Tables):
    """Default vectors of summaries and keywords, cell by cell."""
    return ix.build_vectors(bundles(t)).select("doc_id", F.explode("terms").alias("x")).select("doc_id", "x.term", F.round("x.w", 6).alias("w"))


def load_measures():
    """A stand-in for a neural encoder: length, words and a constant."""
    return lambda texts: [[len(x), len(x.split()), 1.0] for x in texts]


def _measure_sql(c: str) -> str:
    return f"[length({c})::DOUBLE, len(regexp_extract_all({c}, '\\S+'))::DOUBLE, 1.0::DOUBLE]"


_WK = "greatest(0.1::DOUBLE, least(0.4::DOUBLE, 0.1::DOUBLE + 0.01667::DOUBLE * (k - 2)))"


@query("encoded_vector_rows", "UDF1 REC7", f"""WITH kw AS (SELECT document_id, list(keyword ORDER BY rn) AS l FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, keyword) AS rn FROM kws) WHERE rn <= 20 GROUP BY 1),
    b AS (SELECT celex_number AS doc_id, summary, array_to_string(coalesce(l, []), ' ') AS j, len(coalesce(l, [])) AS k FROM summarised LEFT JOIN kw USING (document_id) WHERE trim(coalesce(summary, '')) <> ''),
    m AS (SELECT doc_id, unnest(range(3))::INT AS pos, unnest({_measure_sql('summary')}) AS x, unnest({_measure_sql('j')}) AS y, k FROM b),
    w AS (SELECT doc_id, pos, CASE WHEN k > 0 THEN (1 - {_WK}) * x + {_WK} * y ELSE x END AS w FROM m)
    SELECT doc_id, pos, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS cell FROM w""")
def encoded_vector_rows(t: Tables):
    """Vectors by a user's encoder, loaded in the workers."""
    from docloom.operators.batches import encoder_udf

    rows = ix.build_vectors(bundles(t), encoder=encoder_udf(load_measures))
    return rows.select("doc_id", F.posexplode("vector").alias("pos", "cell")).withColumn("cell", F.round("cell", 6))


_SUBJECTS = ", ".join("CASE WHEN " + " OR ".join(f"contains(b, '{w}')" for w in ws) + f" THEN '{name}' END" for name, ws in ky.SUBJECT_TERMS.items())


@query("vector_features", "REC7 PRJ18 PRJ19", f"""SELECT celex_number AS doc_id, 'authors=European Union;document_type=' || CASE substr(celex_number, 6, 1) WHEN 'R' THEN 'regulation' WHEN 'L' THEN 'directive' WHEN 'D' THEN 'decision' WHEN 'Q' THEN 'recommendation' ELSE 'other' END
    || ';form=' || CASE WHEN contains(s, 'regulation') THEN 'regulation' WHEN contains(s, 'directive') THEN 'directive' WHEN contains(s, 'decision') THEN 'decision' ELSE 'legal text' END || ';subject_matters=' || CASE WHEN len(l) > 0 THEN array_to_string(l, '+') ELSE 'general' END AS features
    FROM (SELECT celex_number, s, list_filter([{_SUBJECTS}], lambda x: x IS NOT NULL) AS l FROM (SELECT celex_number, lower(summary) AS s, lower(coalesce(kw, '') || chr(10) || summary) AS b FROM summarised
      LEFT JOIN (SELECT document_id, string_agg(keyword, ' ' ORDER BY rn) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, keyword) AS rn FROM kws) WHERE rn <= 20 GROUP BY 1) USING (document_id) WHERE trim(coalesce(summary, '')) <> ''))""")
def vector_features(t: Tables):
    return ix.build_vectors(bundles(t)).select("doc_id", mp.as_text(F.transform_values("features", lambda k, v: F.array_join(v, "+"))).alias("features"))


@query("saved_state", "REC8", "SELECT query_id, doc_id, score, rank FROM top10")
def saved_state(t: Tables):
    """Vectors, vocabulary and settings written, read back, and asked."""
    from docloom.operators import features as ft
    from docloom.session import shared_dir

    from .scoring import feature_rows

    path = shared_dir(t.spark, "state")
    ix.save_state(t.vecs.select("doc_id", "vector", "features"), ft.vocabulary(feature_rows(t)), rc.Settings(use_features=False), path)
    vectors, _, settings = ix.load_state(t.spark, path)
    return rc.recommend_by_document(vectors, settings).select("query_id", "doc_id", "score", "rank")


# -- ground truth -------------------------------------------------------------------------------------------------

@query("profile_ground_truth", "SRC7", "SELECT user_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, 1.0::DOUBLE AS rel FROM history")
def profile_ground_truth(t: Tables):
    p = t.history.groupBy("user_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("historical_documents")).select(
        F.col("user_id").cast("string").alias("user_id"), F.lit("expert").alias("expert_description"), "historical_documents")
    return rd.judgements_long(rd.ground_truth(p))


@query("result_ground_truth", "SRC8", "SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS relevant_docs FROM top10 WHERE rank <= 5 GROUP BY 1")
def result_ground_truth(t: Tables):
    out = rd.judgements_from_results(sims10(t), 5)
    return out.select("query_id", F.array_join(F.transform("relevant_docs", lambda d: d.cast("string")), ",").alias("relevant_docs"))


@query("merged_judgements", "SRC9", """SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.rel, a.rel) AS rel FROM (SELECT query_id, doc_id, 1.0::DOUBLE AS rel FROM top10 WHERE rank <= 5) a
    FULL JOIN (SELECT query_id, doc_id, 0.5::DOUBLE AS rel FROM top10 WHERE rank BETWEEN 4 AND 8) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id""")
def merged_judgements(t: Tables):
    r = sims10(t)
    return rd.merge_judgements(
        r.filter("rank <= 5").select("query_id", "doc_id", F.lit(1.0).alias("rel")), r.filter("rank between 4 and 8").select("query_id", "doc_id", F.lit(0.5).alias("rel")))
