"""Joins, picks inside groups and set operations."""

from pyspark.sql import functions as F

from docloom.operators import corpus as cp
from docloom.operators import distribution as ds
from docloom.operators import ranking as rk
from docloom.operators import results as rs
from docloom.functions import text as tx

from .base import Tables, query
from .evaluation import GRADED_SQL, graded
from .projections import TIER_SQL
from .scoring import sims10


@query("documents_with_lookups", "JN1", """SELECT o_orderkey AS document_id, c_mktsegment AS form_name, n_name AS body_name FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0 LEFT JOIN nation ON n_nationkey = o_custkey % 30""")
def documents_with_lookups(t: Tables):
    docs = t.raw("orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("form_id"), F.pmod("o_custkey", F.lit(30)).cast("int").alias("responsible_body_id"))
    forms = t.raw("customer").filter(F.pmod("c_custkey", F.lit(7)) != 0).select(F.col("c_custkey").alias("form_id"), F.col("c_mktsegment").alias("form_name"))
    bodies = t.raw("nation").select(F.col("n_nationkey").alias("body_id"), F.col("n_name").alias("body_name"))
    return cp.with_lookups(docs, forms, bodies).select("document_id", "form_name", "body_name")


def relations(t: Tables):
    li = t.raw("lineitem")
    part = t.raw("part")
    a = cp.linked_names(t.links, t.raw("supplier").select(F.col("s_suppkey").alias("author_id"), "s_name"), "author_id", "s_name", "authors")
    b = li.select(F.col("l_orderkey").alias("document_id"), "l_partkey")
    s = cp.linked_names(b, part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "p_brand", "subject_matters")
    d = cp.linked_names(b, part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey", "p_type", "eurovoc_descriptors")
    return [a, s, d]


@query("document_bundles", "JN2", """SELECT o_orderkey AS document_id, coalesce(a.v, '') AS authors, coalesce(s.v, '') AS subject_matters, coalesce(d.v, '') AS eurovoc_descriptors FROM orders
    LEFT JOIN (SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS v FROM (SELECT DISTINCT l_orderkey, s_name AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1) a ON a.l_orderkey = o_orderkey
    LEFT JOIN (SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS v FROM (SELECT DISTINCT l_orderkey, p_brand AS x FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1) s ON s.l_orderkey = o_orderkey
    LEFT JOIN (SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS v FROM (SELECT DISTINCT l_orderkey, p_type AS x FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1) d ON d.l_orderkey = o_orderkey""")
def document_bundles(t: Tables):
    names = ["authors", "subject_matters", "eurovoc_descriptors"]
    docs = t.raw("orders").select(F.col("o_orderkey").alias("document_id"))
    wide = cp.bundle(docs, cp.list_features(relations(t)), names)
    return wide.select("document_id", *(F.array_join(n, ",").alias(n) for n in names))


@query("sections_by_document", "JN3", """SELECT document_id, section_order, word_count, celex_number FROM secs JOIN (SELECT document_id, celex_number FROM docs) d USING (document_id)""")
def sections_by_document(t: Tables):
    return cp.sections_of(t.docs, t.secs).select("document_id", "section_order", "word_count", "celex_number")


@query("keywords_by_document", "JN4", """SELECT document_id, celex_number, keyword, score FROM kws JOIN (SELECT document_id, celex_number FROM docs) d USING (document_id)""")
def keywords_by_document(t: Tables):
    return cp.keywords_of(t.docs, t.kws).select("document_id", "celex_number", "keyword", "score")


@query("summarised_without_keywords", "JN5", """SELECT document_id FROM summarised s WHERE summary IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kws k WHERE k.document_id = s.document_id AND k.score >= 0.2)""")
def summarised_without_keywords(t: Tables):
    return cp.without_keywords(t.summarised, t.kws.filter("score >= 0.2")).select("document_id")


@query("documents_with_sections", "JN6", """SELECT document_id, celex_number FROM docs d WHERE EXISTS (SELECT 1 FROM secs s WHERE s.document_id = d.document_id AND s.word_count > 60)""")
def documents_with_sections(t: Tables):
    return cp.with_sections(t.docs, t.secs.filter("word_count > 60")).select("document_id", "celex_number")


@query("unseen_documents", "JN7", """SELECT document_id, celex_number FROM docs WHERE document_id NOT IN (SELECT doc_id FROM labels)""")
def unseen_documents(t: Tables):
    seen = t.docs.join(t.raw("labels").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return cp.unseen(t.docs, seen).select("document_id", "celex_number")


@query("author_pair_counts", "JN8", """SELECT a.author_id AS first, b.author_id AS second, count(*) AS documents FROM links a JOIN links b ON a.document_id = b.document_id AND a.author_id < b.author_id GROUP BY 1, 2""")
def author_pair_counts(t: Tables):
    return cp.author_pairs(t.links)


@query("titles_by_key", "JN9", """SELECT k.celex_number, CASE WHEN trim(coalesce(d.title, '')) <> '' THEN trim(d.title) ELSE 'Document ' || k.celex_number END AS title
    FROM (SELECT celex_number FROM docs UNION ALL SELECT 'X' || o_orderkey FROM orders) k LEFT JOIN (SELECT celex_number, CASE WHEN document_id % 5 <> 0 THEN title END AS title FROM docs) d USING (celex_number)""")
def titles_by_key(t: Tables):
    keys = t.docs.select("celex_number").unionByName(t.raw("orders").select(F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("celex_number")))
    some = t.docs.withColumn("title", F.when(F.pmod("document_id", F.lit(5)) != 0, F.col("title")))
    return cp.titles(keys, some)


@query("result_publication_dates", "JN10", """SELECT query_id, doc_id, rank, CAST(date_of_document AS VARCHAR) AS published FROM top10 LEFT JOIN (SELECT document_id AS doc_id, date_of_document FROM docs) d USING (doc_id)""")
def result_publication_dates(t: Tables):
    return cp.with_dates(sims10(t), t.docs).select("query_id", "doc_id", "rank", F.col("date_of_document").cast("string").alias("published"))


@query("documents_by_key", "JN11", """SELECT document_id, celex_number, title, summary FROM summarised WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def documents_by_key(t: Tables):
    wanted = t.raw("labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    keys = t.docs.join(wanted, "document_id", "left_semi")
    return cp.by_key(t.summarised, keys, include_summary=True).select("document_id", "celex_number", "title", "summary")


@query("resolved_history", "JN13", """SELECT user_id, history_id, doc_id FROM (SELECT h.user_id, CASE h.doc_id % 3 WHEN 0 THEN 'CELEX:' || celex_number WHEN 1 THEN lower(celex_number) ELSE ' ' || celex_number END AS history_id, celex_number AS doc_id
    FROM history h JOIN docs d ON d.document_id = h.doc_id)""")
def resolved_history(t: Tables):
    k, c = F.pmod("doc_id", F.lit(3)), F.col("celex_number")
    h = t.history.join(t.docs.select(F.col("document_id").alias("doc_id"), "celex_number"), "doc_id")
    spelled = h.select("user_id", F.when(k == 0, F.concat(F.lit("CELEX:"), c)).when(k == 1, F.lower(c)).otherwise(F.concat(F.lit(" "), c)).alias("history_id"))
    return cp.resolve_history(spelled, t.docs.select(c.alias("doc_id")))


@query("outlier_details", "JN14", """WITH q AS (SELECT quantile_cont(total_words, 0.25) AS a, quantile_cont(total_words, 0.75) AS b FROM docs)
    SELECT document_id, celex_number, form, total_words FROM docs, q WHERE total_words < a - 1.5 * (b - a) OR total_words > b + 1.5 * (b - a)""")
def outlier_details(t: Tables):
    out = ds.iqr_outlier_rows(t.docs.select("document_id", "total_words"), "total_words")
    return cp.outlier_details(t.docs, out).select("document_id", "celex_number", "form", "total_words")


@query("results_with_judgements", "JN15", f"""SELECT query_id, doc_id, rank, coalesce(rel, 0.0::DOUBLE) AS rel FROM top10 LEFT JOIN {GRADED_SQL} g USING (query_id, doc_id)""")
def results_with_judgements(t: Tables):
    from docloom.operators.evaluation import judged

    return judged(sims10(t), graded(t)).select("query_id", "doc_id", "rank", "rel")


@query("results_with_ratings", "JN16", """SELECT query_id, doc_id, score, round(avg_rating, 6) AS avg_rating FROM top10 LEFT JOIN (SELECT document_id AS doc_id, avg(rating) AS avg_rating FROM feedback GROUP BY 1) r USING (doc_id)""")
def results_with_ratings(t: Tables):
    rated = t.feedback.groupBy(F.col("document_id").alias("doc_id")).agg(F.round(F.avg("rating"), 6).alias("avg_rating"))
    return sims10(t).join(rated, "doc_id", "left").select("query_id", "doc_id", "score", "avg_rating")


# -- picks inside groups ------------------------------------------------------------------------------------------

def store(t: Tables):
    """A store holding copies: the key is the text's digest, path and date follow the id."""
    return t.raw("documents").select(
        F.md5("text").alias("celex_number"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file_path"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id") * 31, F.lit(97)).cast("int")).alias("stored_on"))


STORE_SQL = "(SELECT md5(text) AS celex_number, 'doc' || doc_id || '.json' AS file_path, DATE '2024-01-01' + ((doc_id * 31) % 97)::INT AS stored_on FROM documents)"


@query("duplicate_copies", "AGG1", f"SELECT celex_number, file_path, copies FROM (SELECT celex_number, file_path, count(*) OVER (PARTITION BY celex_number) AS copies FROM {STORE_SQL}) WHERE copies > 1")
def duplicate_copies(t: Tables):
    return cp.duplicate_keys(store(t))


@query("earliest_copies", "WIN1", f"""SELECT celex_number, file_path, CAST(stored_on AS VARCHAR) AS stored_on, CASE rn WHEN 1 THEN 'kept' ELSE 'removed' END AS fate FROM
    (SELECT *, row_number() OVER (PARTITION BY celex_number ORDER BY stored_on, file_path) AS rn FROM {STORE_SQL})""")
def earliest_copies(t: Tables):
    kept, removed = cp.keep_earliest(store(t))
    show = lambda df, v: df.select("celex_number", "file_path", F.col("stored_on").cast("string").alias("stored_on"), F.lit(v).alias("fate"))
    return show(kept, "kept").unionByName(show(removed, "removed"))


@query("top_keyword_lists", "WIN2", """SELECT document_id, string_agg(keyword, ',' ORDER BY rn) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, keyword) AS rn FROM kws) WHERE rn <= 20 GROUP BY 1""")
def top_keyword_lists(t: Tables):
    return cp.top_keywords(t.kws).select("document_id", F.array_join("keywords", ",").alias("keywords"))


@query("section_ordinals", "WIN3", "SELECT document_id, section_order, section_type FROM secs")
def section_ordinals(t: Tables):
    return t.secs.select("document_id", "section_order", "section_type")


@query("last_event_per_user", "WIN4", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_event_per_user(t: Tables):
    from docloom.sources.writers import latest

    return latest(t.raw("events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("sampled_documents", "WIN9", f"""SELECT document_id, tier FROM (SELECT document_id, tier, row_number() OVER (PARTITION BY tier ORDER BY md5(celex_number || ':42'), celex_number) AS rn,
    count(*) OVER (PARTITION BY tier) AS n FROM (SELECT document_id, celex_number, {TIER_SQL.format('total_words')} AS tier FROM docs)) WHERE rn <= greatest(floor(0.1::DOUBLE * n), 1)""")
def sampled_documents(t: Tables):
    docs = t.docs.select("document_id", "celex_number", tx.tier(F.col("total_words")).alias("tier"))
    return rk.sample_by_hash(docs, "tier", "celex_number").select("document_id", "tier")


@query("vocabulary_sample", "AGG29", f"""SELECT document_id, tier FROM (SELECT document_id, tier, row_number() OVER (PARTITION BY tier ORDER BY document_id) AS rn FROM
    (SELECT document_id, {TIER_SQL.format('total_words')} AS tier FROM docs)) WHERE rn <= 100""")
def vocabulary_sample(t: Tables):
    docs = t.docs.select("document_id", tx.tier(F.col("total_words")).alias("tier"))
    return rk.top_per_group(docs, ["tier"], [F.col("document_id")], 100).select("document_id", "tier")


# -- sets ---------------------------------------------------------------------------------------------------------

@query("appended_texts", "SET1", """SELECT doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark UNION ALL SELECT conv_id, text, NULL, role FROM conversations""")
def appended_texts(t: Tables):
    a = t.raw("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    b = t.raw("benchmark").select(F.col("item_id").alias("id"), "text")
    c = t.raw("conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("result_overlap", "SET2", """WITH r AS (SELECT query_id, doc_id, a, b, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS rb
      FROM (SELECT query_id, doc_id, round(0.9::DOUBLE * text_score + 0.1::DOUBLE * category_score, 9) AS a, round(0.1::DOUBLE * text_score + 0.9::DOUBLE * category_score, 9) AS b FROM comps))
    SELECT query_id, 'text' AS a, 'category' AS b, count(*) FILTER (ra <= 10 AND rb <= 10) AS shared,
      round(count(*) FILTER (ra <= 10 AND rb <= 10)::DOUBLE / count(*) FILTER (ra <= 10 OR rb <= 10), 6) AS jaccard FROM r GROUP BY 1""")
def result_overlap(t: Tables):
    from docloom.plans.sweep import apply_weights

    from .evaluation import components

    ranked = apply_weights(components(t), [{"text": 0.9, "category": 0.1}, {"text": 0.1, "category": 0.9}])
    named = ranked.withColumn("config", F.when(F.col("config") == 0, "text").otherwise("category"))
    return rs.overlap(named, [("text", "category")])


@query("new_ids", "SET3", "SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def new_ids(t: Tables):
    batch = t.raw("orders").select(F.col("o_custkey").alias("id")).distinct()
    return batch.join(t.raw("events").select(F.col("user_id").alias("id")), "id", "left_anti")
