"""Counts, distributions, outliers, vocabularies, ratings, counters."""

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import corpus as cp
from docloom.operators import distribution as ds
from docloom.operators import features as ft
from docloom.operators import feedback as fb
from docloom.operators import monitoring as mo
from docloom.operators import ngrams as ng
from docloom.operators import results as rs

from .base import STOP_SQL, Tables, query, tokens_sql, write_files
from .projections import TIER_SQL

BIG = 500  # words over which a document counts as long on these tables


@query("section_word_totals", "AGG2", "SELECT document_id, coalesce(w, 0)::BIGINT AS total_words FROM (SELECT document_id FROM docs) d LEFT JOIN (SELECT document_id, sum(word_count)::BIGINT AS w FROM secs GROUP BY 1) s USING (document_id)")
def section_word_totals(t: Tables):
    return cp.set_total_words(t.docs.select("document_id", "total_words"), t.secs)


@query("corpus_word_stats", "AGG3", "SELECT count(*) AS documents, round(avg(total_words), 6) AS avg_words, min(total_words) AS min_words, max(total_words) AS max_words FROM docs")
def corpus_word_stats(t: Tables):
    return ds.corpus_stats(t.docs)


@query("documents_per_tier", "AGG4", f"""SELECT {TIER_SQL.format('total_words')} AS tier, count(*) AS documents, min(total_words) AS min_words, max(total_words) AS max_words,
    round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM docs), 6) AS share FROM docs GROUP BY 1""")
def documents_per_tier(t: Tables):
    return cp.tier_counts(t.docs)


_DESC = """count(*) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0}) AS min, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS median,
    round(quantile_cont({0}, 0.75), 6) AS p75, round(quantile_cont({0}, 0.95), 6) AS p95, max({0}) AS max"""


@query("length_profile_by_form", "AGG5", f"""SELECT form, 'total_words' AS measure, {_DESC.format('total_words')} FROM docs GROUP BY form
    UNION ALL SELECT form, 'length_chars', {_DESC.format('length_chars')} FROM docs GROUP BY form""")
def length_profile_by_form(t: Tables):
    return ds.length_profile(t.docs, "form", ["total_words", "length_chars"])


@query("described_lengths", "AGG6", f"SELECT {_DESC.format('length_chars')} FROM docs")
def described_lengths(t: Tables):
    return ds.describe(t.docs, "length_chars")


@query("null_report", "AGG7", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_pct FROM docs"
    for c in ("document_id", "title", "form", "responsible_body", "date_of_document")))
def null_report(t: Tables):
    return cp.null_report(t.docs, ["document_id", "title", "form", "responsible_body", "date_of_document"])


@query("missing_dates_by_form", "AGG8", "SELECT form, round(avg((date_of_document IS NULL)::INT::DOUBLE), 6) AS missing_share FROM docs GROUP BY form")
def missing_dates_by_form(t: Tables):
    return cp.missing_share(t.docs, "date_of_document", "form")


@query("top_forms", "AGG9", "SELECT form, count(*) AS n FROM docs GROUP BY form ORDER BY n DESC, form ASC NULLS FIRST LIMIT 20")
def top_forms(t: Tables):
    return cp.value_counts(t.docs, "form")


@query("documents_per_form", "AGG10", """SELECT form_name, count(*) AS documents FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment AS form_name FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey GROUP BY 1""")
def documents_per_form(t: Tables):
    counts = t.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    forms = t.raw("customer").filter(F.pmod("c_custkey", F.lit(7)) != 0).select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("form_name"))
    return counts.join(forms, "o_custkey", "left").groupBy("form_name").agg(F.sum("n").alias("documents"))


@query("documents_per_author", "AGG11", "SELECT s_name, count(*) AS documents FROM links JOIN supplier ON s_suppkey = author_id GROUP BY 1")
def documents_per_author(t: Tables):
    return cp.documents_per_link(t.links, t.raw("supplier").select(F.col("s_suppkey").alias("author_id"), "s_name"), "author_id", "s_name")


@query("form_by_body", "AGG12", """SELECT form, count(*) FILTER (responsible_body = 'de') AS de, count(*) FILTER (responsible_body = 'en') AS en, count(*) FILTER (responsible_body = 'es') AS es, count(*) FILTER (responsible_body = 'fr') AS fr FROM docs GROUP BY form""")
def form_by_body(t: Tables):
    return cp.crosstab(t.docs, "form", "responsible_body", ["de", "en", "es", "fr"])


@query("form_body_counts", "AGG12", "SELECT form, responsible_body, count(*) AS n FROM docs GROUP BY 1, 2")
def form_body_counts(t: Tables):
    return cp.cross_counts(t.docs, "form", "responsible_body")


@query("documents_per_month", "AGG13", "SELECT CAST(date_trunc('month', date_of_document)::DATE AS VARCHAR) AS month_start, count(*) AS documents FROM docs WHERE date_of_document IS NOT NULL GROUP BY 1")
def documents_per_month(t: Tables):
    return cp.documents_per_month(t.docs).withColumn("month_start", F.col("month_start").cast("string"))


@query("documents_per_calendar_month", "AGG13", "SELECT month(date_of_document)::INT AS month, count(*) AS documents FROM docs WHERE date_of_document IS NOT NULL GROUP BY 1")
def documents_per_calendar_month(t: Tables):
    return cp.documents_per_calendar_month(t.docs)


@query("word_percentiles", "AGG14", " UNION ALL ".join(f"SELECT {p} AS percentile, round(quantile_cont(total_words, {p / 100}), 6) AS value FROM docs" for p in ds.PERCENTILES))
def word_percentiles(t: Tables):
    return ds.percentiles(t.docs, "total_words")


@query("iqr_outlier_counts", "AGG15", """WITH q AS (SELECT quantile_cont(total_words, 0.25) AS a, quantile_cont(total_words, 0.75) AS b FROM docs), r AS (SELECT a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q)
    SELECT round(any_value(low), 6)::DOUBLE AS low, round(any_value(high), 6)::DOUBLE AS high, count(*) FILTER (total_words < low OR total_words > high) AS outliers,
    round(count(*) FILTER (total_words < low OR total_words > high) * 100.0::DOUBLE / count(*), 6) AS outlier_pct FROM docs, r""")
def iqr_outlier_counts(t: Tables):
    return ds.iqr_outliers(t.docs, "total_words")


def _z_sql(thresholds):
    return f"""WITH s AS (SELECT avg(total_words) AS m, stddev_samp(total_words) AS d FROM docs), z AS (SELECT total_words, abs((total_words - m) / d) AS az FROM docs, s), x AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in thresholds)}]) AS threshold)
    SELECT threshold, count(*) FILTER (az > threshold) AS outliers, count(*) FILTER (az <= threshold) AS retained, round(count(*) FILTER (az <= threshold) * 100.0::DOUBLE / count(*), 6) AS retained_pct,
    min(total_words) FILTER (az <= threshold) AS min_retained, max(total_words) FILTER (az <= threshold) AS max_retained FROM z, x GROUP BY threshold"""


@query("z_outlier_counts", "AGG16", _z_sql((3.0,)))
def z_outlier_counts(t: Tables):
    return ds.z_outliers(t.docs, "total_words")


@query("z_threshold_sweep", "AGG17", _z_sql(ds.Z_THRESHOLDS))
def z_threshold_sweep(t: Tables):
    return ds.z_outliers(t.docs, "total_words", ds.Z_THRESHOLDS)


@query("z_for_retention", "AGG18", """WITH s AS (SELECT avg(total_words) AS m, stddev_samp(total_words) AS d FROM docs), z AS (SELECT abs((total_words - m) / d) AS az FROM docs, s), c AS (SELECT quantile_cont(az, 0.95) AS cut FROM z)
    SELECT round(any_value(cut), 6) AS threshold, count(*) FILTER (az <= cut) AS retained, round(count(*) FILTER (az <= cut) * 100.0::DOUBLE / count(*), 6) AS retained_pct FROM z, c""")
def z_for_retention(t: Tables):
    return ds.z_for_retention(t.docs, "total_words", 0.95)


@query("long_documents_by_form", "AGG19", f"SELECT form, count(*) FILTER (total_words >= {BIG}) AS over_limit, count(*) AS documents FROM docs GROUP BY form")
def long_documents_by_form(t: Tables):
    return ds.over_limit(t.docs, "total_words", "form", BIG)


@query("filtered_length_profile", "AGG19", f"SELECT {_DESC.format('total_words')} FROM docs WHERE total_words < {BIG}")
def filtered_length_profile(t: Tables):
    kept, _ = ds.split_at(t.docs, "total_words", BIG)
    return ds.describe(kept, "total_words")


@query("excluded_documents", "AGG19", f"SELECT document_id, celex_number, total_words FROM docs WHERE total_words >= {BIG}")
def excluded_documents(t: Tables):
    return ds.split_at(t.docs, "total_words", BIG)[1].select("document_id", "celex_number", "total_words")


@query("section_lengths_by_type", "AGG20", f"SELECT section_type, {_DESC.format('word_count')} FROM secs GROUP BY 1")
def section_lengths_by_type(t: Tables):
    return ds.describe(t.secs, "word_count", "section_type")


@query("sections_per_document", "AGG20", "SELECT count(*) AS documents, round(avg(c), 6) AS mean_sections, round(quantile_cont(c, 0.5), 6)::DOUBLE AS median_sections FROM (SELECT document_id, count(*) AS c FROM secs GROUP BY 1)")
def sections_per_document(t: Tables):
    return ds.per_document_counts(t.secs)


@query("top_tokens", "AGG21", r"SELECT term, count(*) AS n FROM (SELECT unnest(toks) AS term FROM toks) WHERE regexp_matches(term, '^\p{L}+$') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def top_tokens(t: Tables):
    return ng.top_tokens(t.texts)


def _ngram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"""SELECT term, count(*) AS n, count(DISTINCT document_id) AS docs FROM (SELECT document_id, {gram} AS term FROM (SELECT document_id, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM
        (SELECT document_id, {tokens_sql('content', 2)} AS t FROM docs))) GROUP BY term HAVING count(DISTINCT document_id) >= 2 ORDER BY n DESC, term LIMIT 20"""


@query("top_bigrams", "AGG22", _ngram_sql(2))
def top_bigrams(t: Tables):
    return ng.top_ngrams(t.texts, 2)


@query("top_trigrams", "AGG22", _ngram_sql(3))
def top_trigrams(t: Tables):
    return ng.top_ngrams(t.texts, 3)


_RATED = ", ".join(f"count(*) FILTER (rating = {r}) AS rated_{r}" for r in range(1, 6))


@query("document_ratings", "AGG23", f"SELECT document_id, count(*) AS ratings, round(avg(rating), 6) AS avg_rating, {_RATED} FROM feedback GROUP BY 1")
def document_ratings(t: Tables):
    return fb.document_ratings(t.feedback)


@query("user_ratings", "AGG24", "SELECT user_id, count(*) AS ratings, round(avg(rating), 6) AS avg_rating, count(DISTINCT document_id) FILTER (rating >= 4) AS liked_documents FROM feedback GROUP BY 1")
def user_ratings(t: Tables):
    return fb.user_statistics(t.feedback)


@query("liked_documents", "AGG24", "SELECT DISTINCT user_id, document_id FROM feedback WHERE rating >= 4")
def liked_documents(t: Tables):
    return fb.liked_documents(t.feedback)


@query("overall_ratings", "AGG25", f"SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT document_id) AS documents, round(avg(rating), 6) AS avg_rating, {_RATED} FROM feedback")
def overall_ratings(t: Tables):
    return fb.overall_statistics(t.feedback)


@query("joined_section_texts", "AGG26", "SELECT document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY section_order)) AS text_md5 FROM secs GROUP BY 1")
def joined_section_texts(t: Tables):
    return cp.section_texts(t.secs).select("document_id", F.md5("content").alias("text_md5"))


_FEATURES_SQL = """(SELECT document_id, 'form' AS feature, form AS value FROM docs WHERE form IS NOT NULL UNION ALL SELECT document_id, 'responsible_body', responsible_body FROM docs
    UNION ALL SELECT document_id, 'subject_matters', unnest([source, lang]) FROM docs)"""


def feature_rows(t: Tables):
    docs = t.docs.select(F.col("document_id").alias("id"), "form", "responsible_body", F.array("source", "lang").alias("subject_matters"))
    return ft.feature_rows(docs), docs


@query("feature_vocabulary", "AGG27", f"SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::INT AS position FROM (SELECT DISTINCT feature, value FROM {_FEATURES_SQL})")
def feature_vocabulary(t: Tables):
    return ft.vocabulary(feature_rows(t)[0])


@query("feature_importance", "AGG28", f"""WITH c AS (SELECT feature, value, count(*)::DOUBLE AS n FROM {_FEATURES_SQL} GROUP BY ALL), h AS (SELECT feature, -sum(n / tot * ln(n / tot)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS tot FROM c) GROUP BY 1),
    v AS (SELECT feature, count(DISTINCT document_id)::DOUBLE / (SELECT count(*) FROM docs) AS coverage FROM {_FEATURES_SQL} GROUP BY 1), r AS (SELECT feature, 0.7::DOUBLE * entropy + 0.3::DOUBLE * coverage AS raw FROM h JOIN v USING (feature))
    SELECT feature, round(raw / (SELECT max(raw) FROM r), 6) AS importance FROM r""")
def feature_importance(t: Tables):
    rows, docs = feature_rows(t)
    return ft.importance(rows, docs)


@query("ingest_counters", "AGG30", "SELECT event_type, CAST(day AS VARCHAR) AS day, count(*) AS n FROM feedback GROUP BY 1, 2")
def ingest_counters(t: Tables):
    return mo.status_counts(t.feedback, "event_type", "day").withColumn("day", F.col("day").cast("string"))


@query("processing_time_buckets", "AGG30", "SELECT event_type, le, count(*) FILTER (value <= le) AS n, count(*) AS total FROM events, (SELECT unnest([1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0])::DOUBLE AS le) GROUP BY 1, 2")
def processing_time_buckets(t: Tables):
    return mo.time_buckets(t.raw("events"), "value", mo.TIME_BUCKETS, "event_type")


@query("metric_sessions", "AGG31 SRC5", """SELECT 'metrics_' || strftime(day, '%Y%m%d') || '_000000.prom' AS file, sum(value) FILTER (event_type = 'click')::DOUBLE AS documents_processed_total, count(*) FILTER (event_type = 'view')::DOUBLE AS requests_total
    FROM (SELECT day, event_type, round(value, 1) AS value FROM feedback) GROUP BY day HAVING sum(value) FILTER (event_type = 'click') > 1""")
def metric_sessions(t: Tables):
    from docloom.session import shared_dir
    from docloom.sources.readers import read_metric_samples

    # Events as metric lines, one file per day, written and read back.
    e = t.feedback
    line = F.when(F.col("event_type") == "click", F.format_string('documents_processed_total{id="%d"} %.1f', "event_id", F.round("value", 1))).when(
        F.col("event_type") == "view", F.format_string('requests_total{id="%d"} 1', "event_id")).otherwise(F.format_string("# %d", "event_id"))
    lines = e.select(F.concat(F.lit("metrics_"), F.date_format("day", "yyyyMMdd"), F.lit("_000000.prom")).alias("file"), line.alias("value"))
    path = shared_dir(t.spark, "metrics")
    write_files(lines, path)
    out = mo.session_table(read_metric_samples(t.spark, path))
    return out.select("file", F.round("documents_processed_total", 6).alias("documents_processed_total"), "requests_total")


@query("result_summaries", "AGG32", """SELECT query_id, count(*) AS n, round(avg(score), 9) AS avg_score, max(score) AS max_score, count(DISTINCT doc_id % 5) AS types, min(2000 + doc_id % 25)::INT AS first_year, max(2000 + doc_id % 25)::INT AS last_year FROM top10 GROUP BY 1""")
def result_summaries(t: Tables):
    from .scoring import sims10

    i = F.col("doc_id")
    rows = sims10(t).withColumns({"document_type": F.pmod(i, F.lit(5)), "year": (F.pmod(i, F.lit(25)) + 2000).cast("int")})
    return rs.summary(rows)


@query("result_subjects", "AGG33", """SELECT subject, count(*) AS n FROM (SELECT unnest(['l' || label, 'g' || grp]) AS subject FROM top10 JOIN vecs USING (doc_id)) GROUP BY 1 ORDER BY n DESC, subject LIMIT 10""")
def result_subjects(t: Tables):
    from .scoring import sims10

    subjects = t.vecs.select("doc_id", F.element_at("features", F.lit("subject_matters")).alias("subjects"))
    return rs.subject_counts(sims10(t).join(subjects, "doc_id"))


@query("document_year_histogram", "AGG33", """WITH y AS (SELECT year(date_of_document)::INT AS y, count(*) AS n FROM docs WHERE date_of_document IS NOT NULL AND year(date_of_document) BETWEEN 1950 AND 2024 GROUP BY 1), s AS (SELECT min(y) AS lo, max(y) AS hi, least(count(*), 20) AS k FROM y)
    SELECT floor((y - lo) / ((hi - lo + 1)::DOUBLE / k))::INT AS bin, min(y) AS from_year, max(y) AS to_year, sum(n)::BIGINT AS n FROM y, s GROUP BY 1""")
def document_year_histogram(t: Tables):
    return rs.year_histogram(t.docs.withColumn("year", F.year("date_of_document")), 2024)


@query("length_density", "AGG34", """WITH f AS (SELECT length_chars AS v, count(*) AS n FROM docs GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS n, stddev_samp(length_chars) * count(*)::DOUBLE ** -0.2 AS h, max(length_chars) / 999.0::DOUBLE AS step FROM docs)
    SELECT i, round(sum(f.n * exp(0 - pow((i * step - v) / h, 2) / 2)) / (any_value(s.n) * any_value(h) * sqrt(2 * pi())), 12) AS density FROM f, s, (SELECT unnest(range(1000))::INT AS i) GROUP BY i HAVING round(sum(f.n * exp(0 - pow((i * step - v) / h, 2) / 2)) / (any_value(s.n) * any_value(h) * sqrt(2 * pi())), 12) > 0""")
def length_density(t: Tables):
    return ds.density(t.docs, "length_chars").select("i", F.round("density", 12).alias("density")).filter("density > 0")


@query("length_density_peaks", "AGG34", """WITH f AS (SELECT length_chars AS v, count(*) AS n FROM docs GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS n, stddev_samp(length_chars) * count(*)::DOUBLE ** -0.2 AS h, max(length_chars) / 999.0::DOUBLE AS step FROM docs),
    g AS (SELECT i, any_value(step) AS step, sum(f.n * exp(0 - pow((i * step - v) / h, 2) / 2)) AS d FROM f, s, (SELECT unnest(range(1000))::INT AS i) GROUP BY i), w AS (SELECT *, lag(d) OVER (ORDER BY i) AS before, lead(d) OVER (ORDER BY i) AS after FROM g)
    SELECT i, floor(i * step)::BIGINT AS length FROM w WHERE d > before AND d > after""")
def length_density_peaks(t: Tables):
    return ds.density_peaks(t.docs, "length_chars").select("i", "length")


@query("retained_counts", "AGG35", f"SELECT count(*) FILTER (total_words < {BIG}) AS retained, count(*) FILTER (total_words >= {BIG}) AS excluded, round(count(*) FILTER (total_words < {BIG}) * 100.0::DOUBLE / count(*), 6) AS retained_pct FROM docs")
def retained_counts(t: Tables):
    return ds.retained_counts(t.docs, "total_words", BIG)


@query("excluded_forms", "AGG35", f"SELECT form, count(*) AS n FROM docs WHERE total_words >= {BIG} GROUP BY 1")
def excluded_forms(t: Tables):
    return cp.value_counts(ds.split_at(t.docs, "total_words", BIG)[1], "form", None)
