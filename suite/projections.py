"""Row-wise measures, cleaning, dates, keys and requests."""

from pyspark.sql import functions as F

from docloom.functions import dates as dt
from docloom.functions import keys as ky
from docloom.functions import text as tx
from docloom.operators import ranking as rk
from docloom.session import spread

from .base import STOP_SQL, Tables, query, tokens_sql, words_sql


@query("word_counts", "PRJ1", f"SELECT doc_id, {words_sql('text')}::INT AS words FROM documents")
def word_counts(t: Tables):
    return t.raw("documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


TIER_SQL = "CASE WHEN {0} <= 600 THEN 1 WHEN {0} <= 2500 THEN 2 WHEN {0} <= 20000 THEN 3 ELSE 4 END"


@query("tiers", "PRJ2", f"SELECT document_id, {TIER_SQL.format('total_words')} AS tier FROM docs")
def tiers(t: Tables):
    return t.docs.select("document_id", tx.tier(F.col("total_words")).alias("tier"))


@query("tier_ranges", "PRJ3", """SELECT 1 AS tier, document_id FROM docs WHERE total_words BETWEEN 0 AND 600
    UNION ALL SELECT 2, document_id FROM docs WHERE total_words BETWEEN 601 AND 2500
    UNION ALL SELECT 3, document_id FROM docs WHERE total_words BETWEEN 2501 AND 20000
    UNION ALL SELECT 4, document_id FROM docs WHERE total_words > 20000""")
def tier_ranges(t: Tables):
    hits = F.array_compact(F.array(*(F.when(tx.in_tier(F.col("total_words"), i), i) for i in (1, 2, 3, 4))))
    return t.docs.select(F.explode(hits).alias("tier"), "document_id")


@query("compression_ratios", "PRJ4", rf"""SELECT document_id, round(coalesce({words_sql('summary')}::DOUBLE / nullif(total_words, 0), 0), 6) AS word_ratio,
    round(coalesce(length(summary)::DOUBLE / nullif(length_chars, 0), 0), 6) AS char_ratio FROM summarised WHERE summary IS NOT NULL""")
def compression_ratios(t: Tables):
    s = F.col("summary")
    return t.summarised.filter(s.isNotNull()).select(
        "document_id", F.round(tx.ratio(tx.word_count(s), F.col("total_words")), 6).alias("word_ratio"),
        F.round(tx.ratio(F.length(s), F.col("length_chars")), 6).alias("char_ratio"))


CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
    'https?://[!$-_a-z]+', '', 'g'), 'www\.[!$-_a-z]+', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'),
    '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10) || chr(10), 'g'), '\n\s+', chr(10), 'g'), E' \t\r\n')"""


@query("clean_legal_texts", "PRJ5", f"""SELECT doc_id, md5(CASE WHEN regexp_matches(c, '[a-zA-Z]{{2,}}') THEN c ELSE '' END) AS clean_md5
    FROM (SELECT doc_id, {CLEAN_SQL.format('text')} AS c FROM documents)""")
def clean_legal_texts(t: Tables):
    return spread(t.raw("documents")).select("doc_id", F.md5(tx.clean_legal_text(F.col("text"))).alias("clean_md5"))


@query("valid_sections", "PRJ6", "SELECT document_id, section_order, regexp_matches(content, '[a-zA-Z]{2,}')::INT AS valid FROM secs")
def valid_sections(t: Tables):
    return t.secs.select("document_id", "section_order", tx.is_valid_section(F.col("content")).cast("int").alias("valid"))


@query("distinct_line_texts", "PRJ7 SET4", r"""SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))) AS lines_md5
    FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS l FROM documents)""")
def distinct_line_texts(t: Tables):
    return t.raw("documents").select("doc_id", F.md5(tx.distinct_lines(F.col("text"))).alias("lines_md5"))


@query("squeezed_texts", "PRJ8", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM documents")
def squeezed_texts(t: Tables):
    return t.raw("documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("text_md5"))


# Ids in the forms met in links: with and without the prefix, corrigenda (9 in fifth place), too short, no digits.
ID_SQL = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'L_2024' || lpad((event_id % 89999)::VARCHAR, 5, '0') WHEN 1 THEN '2023' || lpad((event_id % 89999)::VARCHAR, 5, '0')
    WHEN 2 THEN 'L_20249' || lpad((event_id % 9999)::VARCHAR, 4, '0') WHEN 3 THEN '20' || event_id::VARCHAR ELSE 'C_' || event_id::VARCHAR END AS raw_id FROM events)"""


def raw_ids(t: Tables):
    i = F.col("event_id")
    pad = lambda m, n: F.lpad(F.pmod(i, F.lit(m)).cast("string"), n, "0")
    k = F.pmod(i, F.lit(5))
    raw = (
        F.when(k == 0, F.concat(F.lit("L_2024"), pad(89999, 5))).when(k == 1, F.concat(F.lit("2023"), pad(89999, 5)))
        .when(k == 2, F.concat(F.lit("L_20249"), pad(9999, 4))).when(k == 3, F.concat(F.lit("20"), i.cast("string")))
        .otherwise(F.concat(F.lit("C_"), i.cast("string")))
    )
    return t.raw("events").select("event_id", raw.alias("raw_id"))


@query("accepted_document_ids", "PRJ9", f"""SELECT event_id, raw_id FROM {ID_SQL}
    WHERE length(regexp_replace(raw_id, '^L_', '')) = 9 AND regexp_matches(regexp_replace(raw_id, '^L_', ''), '^[0-9]{{4}}') AND substr(regexp_replace(raw_id, '^L_', ''), 5, 1) <> '9'""")
def accepted_document_ids(t: Tables):
    return raw_ids(t).filter(ky.is_document_id(F.col("raw_id")))


IDENT_SQL = """(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus || '/' || year(o_orderdate)::VARCHAR || '/' || o_custkey::VARCHAR
    WHEN 1 THEN o_orderstatus || '/' || year(o_orderdate)::VARCHAR || '/' || o_custkey::VARCHAR || '/EU' WHEN 2 THEN o_orderpriority ELSE ' ' END AS raw FROM orders)"""


@query("clean_identifiers", "PRJ10", f"""SELECT o_orderkey, CASE WHEN regexp_matches(trim(raw), '^[A-Z]/[0-9]{{4}}/[0-9]+(/[A-Z]+)?$') THEN trim(raw) ELSE '' END AS identifier FROM {IDENT_SQL}""")
def clean_identifiers(t: Tables):
    k = F.pmod("o_orderkey", F.lit(4))
    base = F.concat_ws("/", "o_orderstatus", F.year("o_orderdate").cast("string"), F.col("o_custkey").cast("string"))
    raw = F.when(k == 0, base).when(k == 1, F.concat(base, F.lit("/EU"))).when(k == 2, F.col("o_orderpriority")).otherwise(F.lit(" "))
    return t.raw("orders").select("o_orderkey", ky.clean_identifier(raw).alias("identifier"))


@query("validated_metadata", "PRJ11", """SELECT document_id, array_to_string(list_filter([CASE WHEN document_id % 17 = 0 THEN 'celex_number missing' END,
    CASE WHEN trim(title) = '' THEN 'title missing' END, CASE WHEN document_id % 19 = 0 THEN 'eli_uri is no address' END], lambda x: x IS NOT NULL), ';') AS reasons,
    CASE WHEN document_id % 17 <> 0 AND trim(title) <> '' AND document_id % 19 <> 0 THEN 'good' ELSE 'rejected' END AS verdict FROM docs""")
def validated_metadata(t: Tables):
    from docloom.operators import markup as mk

    i = F.col("document_id")
    rec = t.docs.select(
        "document_id", F.when(F.pmod(i, F.lit(17)) != 0, F.col("celex_number")).alias("celex_number"), "title", F.lit("").alias("identifier"),
        F.when(F.pmod(i, F.lit(19)) != 0, F.concat(F.lit("http://data.europa.eu/eli/"), i.cast("string"))).otherwise("none").alias("eli_uri"))
    good, bad = mk.split_valid(mk.validate(rec))
    show = lambda df, v: df.select("document_id", F.array_join("reasons", ";").alias("reasons"), F.lit(v).alias("verdict"))
    return show(good, "good").unionByName(show(bad, "rejected"))


def _dates(name: str, covers: str, patterns, formats, sql_patterns):
    """Order dates written in one of several ways by key, parsed back by the cascade."""
    cases = " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{p}')" for i, p in enumerate(sql_patterns))
    tries = ", ".join(f"try_strptime(raw, '{p}')" for p in sql_patterns)
    n = len(patterns) + 1

    @query(name, covers, f"""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % {n} < {n - 1} THEN want END AS VARCHAR) AS parsed FROM (SELECT o_orderkey,
        CASE o_orderkey % {n} {cases} ELSE 'no date' END AS raw, CASE o_orderkey % {n} {' '.join(f"WHEN {i} THEN " + ("date_trunc('year', o_orderdate)::DATE" if p == '%Y' else "date_trunc('month', o_orderdate)::DATE" if p == '%Y-%m' else "o_orderdate::DATE") for i, p in enumerate(sql_patterns))} END AS want FROM orders)""")
    def run(t: Tables):
        k = F.pmod("o_orderkey", F.lit(n))
        raw = F.when(k == 0, F.date_format("o_orderdate", patterns[0]))
        for i, p in enumerate(patterns[1:], 1):
            raw = raw.when(k == i, F.date_format("o_orderdate", p))
        return t.raw("orders").select("o_orderkey", dt.parse_date(raw.otherwise("no date"), formats).cast("string").alias("parsed"))


_dates("ingest_dates", "PRJ12", dt.INGEST_FORMATS, dt.INGEST_FORMATS, ("%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d"))
_dates("ranker_dates", "PRJ13", dt.RANKER_FORMATS, dt.RANKER_FORMATS,
       ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%Y", "%Y-%m", "%b %-d, %Y", "%-d %b %Y"))


@query("result_dates", "PRJ14", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS VARCHAR) AS found FROM orders""")
def result_dates(t: Tables):
    k = F.pmod("o_orderkey", F.lit(3))
    first = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("unknown")
    second = F.when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.raw("orders").select("o_orderkey", dt.first_date([first, second, F.lit(None).cast("string")]).cast("string").alias("found"))


@query("ingest_calendar", "PRJ15", """WITH days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY))::DATE AS d)
    SELECT CAST(d AS VARCHAR) AS day, count(event_id) AS events FROM days LEFT JOIN events ON ts::DATE = d GROUP BY d""")
def ingest_calendar(t: Tables):
    start, end = "2024-01-01", "2024-01-20"
    dt.check_range(start, end)
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    e = t.raw("events").select(F.to_date("ts").alias("day")).filter(F.col("day").between(start, end)).groupBy("day").agg(F.count("*").alias("events"))
    return days.join(e, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("events", F.lit(0)).alias("events"))


@query("dates_from_paths", "PRJ16", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE ELSE DATE '1970-01-01' END AS VARCHAR) AS stored_on FROM orders""")
def dates_from_paths(t: Tables):
    k, d = F.pmod("o_orderkey", F.lit(3)), F.col("o_orderdate")
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".json"))
    path = (
        F.when(k == 0, F.concat_ws("/", F.lit("/data"), F.date_format(d, "yyyy/MM/dd"), name))
        .when(k == 1, F.concat_ws("/", F.lit("/data"), F.date_format(d, "yyyyMMdd"), name)).otherwise(F.concat(F.lit("/data/other/"), name))
    )
    return t.raw("orders").select("o_orderkey", dt.date_from_path(path).cast("string").alias("stored_on"))


@query("document_types", "PRJ17", """SELECT document_id, CASE substr(celex_number, 6, 1) WHEN 'R' THEN 'regulation' WHEN 'L' THEN 'directive' WHEN 'D' THEN 'decision'
    WHEN 'Q' THEN 'recommendation' ELSE 'other' END AS document_type FROM docs""")
def document_types(t: Tables):
    return t.docs.select("document_id", ky.document_type(F.col("celex_number")).alias("document_type"))


# The driver texts are invented words, so the terms looked for are given as a parameter.
DEMO_TERMS = {"alpha": ("tion", "ment"), "beta": ("ouble",), "gamma": ("lich", "schen")}


@query("inferred_subjects", "PRJ18", """SELECT document_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'general' END AS subjects FROM (SELECT document_id, list_filter([
    CASE WHEN contains(s, 'tion') OR contains(s, 'ment') THEN 'alpha' END, CASE WHEN contains(s, 'ouble') THEN 'beta' END,
    CASE WHEN contains(s, 'lich') OR contains(s, 'schen') THEN 'gamma' END], lambda x: x IS NOT NULL) AS l FROM (SELECT document_id, lower(summary) AS s FROM summarised WHERE summary IS NOT NULL))""")
def inferred_subjects(t: Tables):
    rows = t.summarised.filter(F.col("summary").isNotNull())
    return rows.select("document_id", F.array_join(ky.subjects(F.lit(""), F.col("summary"), DEMO_TERMS), ",").alias("subjects"))


@query("inferred_forms", "PRJ19", """SELECT p_partkey, CASE WHEN contains(s, 'regulation') THEN 'regulation' WHEN contains(s, 'directive') THEN 'directive'
    WHEN contains(s, 'decision') THEN 'decision' ELSE 'legal text' END AS form FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' regulation' WHEN 1 THEN p_name || ' directive'
    WHEN 2 THEN 'decision ' || p_name ELSE p_name END AS s FROM part)""")
def inferred_forms(t: Tables):
    k, n = F.pmod("p_partkey", F.lit(4)), F.col("p_name")
    s = F.when(k == 0, F.concat(n, F.lit(" Regulation"))).when(k == 1, F.concat(n, F.lit(" directive"))).when(k == 2, F.concat(F.lit("Decision "), n)).otherwise(n)
    return t.raw("part").select("p_partkey", ky.form_of(s).alias("form"))


@query("fallback_titles", "PRJ20", r"""SELECT document_id, coalesce(given, l[1], CASE WHEN length(split_part(summary, '.', 1)) > 10 THEN split_part(summary, '.', 1) || '.' END, 'Document ' || celex_number) AS title
    FROM (SELECT document_id, celex_number, content AS summary, CASE WHEN document_id % 3 = 0 AND trim(title) <> '' THEN title END AS given,
      list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS l FROM docs)""")
def fallback_titles(t: Tables):
    given = F.when(F.pmod("document_id", F.lit(3)) == 0, F.col("title"))
    return t.docs.select("document_id", ky.title_or_fallback(given, F.col("content"), F.col("celex_number")).alias("title"))


@query("default_fields", "PRJ21", """SELECT document_id, CASE WHEN document_id % 2 = 0 AND trim(title) <> '' THEN title ELSE 'EU Regulation ' || celex_number END AS title, 'Legal Affairs' AS subject,
    substr(celex_number, 2, 4)::INT AS year, 'https://publisher.example/legal-content/EN/TXT/?uri=CELEX:' || celex_number AS url FROM docs""")
def default_fields(t: Tables):
    k = F.col("celex_number")
    title = F.when(F.pmod("document_id", F.lit(2)) == 0, F.col("title"))
    return t.docs.select("document_id", ky.default_title(title, k).alias("title"), ky.default_subject(k).alias("subject"),
                         ky.key_year(k).alias("year"), ky.key_url(k).alias("url"))


@query("matched_subjects", "PRJ22", """SELECT document_id, array_to_string(list_filter([CASE WHEN contains(c, 'then') THEN 'Then' END, CASE WHEN contains(c, 'tionre') THEN 'Tionre' END,
    CASE WHEN contains(c, 'sch') THEN 'Sch' END, CASE WHEN contains(c, 'que') THEN 'Que' END], lambda x: x IS NOT NULL)[1:2], ',') AS subjects FROM (SELECT document_id, lower(content) AS c FROM docs)""")
def matched_subjects(t: Tables):
    return t.texts.select("document_id", F.array_join(ky.matched_subjects(F.col("content"), ("Then", "Tionre", "Sch", "Que"), 2), ",").alias("subjects"))


@query("known_subjects", "PRJ22", "SELECT document_id, array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN contains(c, '{s.lower()}') THEN '{s}' END" for s in ky.KNOWN_SUBJECTS)
       + "], lambda x: x IS NOT NULL)[1:5], ',') AS subjects FROM (SELECT document_id, lower(content || ' ' || array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN document_id % {n + 2} = 0 THEN '{s.upper()}' END" for n, s in enumerate(ky.KNOWN_SUBJECTS))
       + "], lambda x: x IS NOT NULL), ' ')) AS c FROM docs)")
def known_subjects(t: Tables):
    """A document's text names subjects by its id, written in capitals: none, some, or more than five."""
    named = [F.when(F.pmod("document_id", F.lit(n + 2)) == 0, F.lit(s.upper())) for n, s in enumerate(ky.KNOWN_SUBJECTS)]
    text = F.concat_ws(" ", F.col("content"), F.array_compact(F.array(*named)))
    return t.texts.select("document_id", F.array_join(ky.matched_subjects(text), ",").alias("subjects"))


@query("display_dates", "PRJ23", "SELECT document_id, coalesce(strftime(date_of_document, '%d/%m/%Y'), 'N/A') AS shown, coalesce(year(date_of_document)::VARCHAR, 'N/A') AS year FROM docs")
def display_dates(t: Tables):
    d = F.col("date_of_document")
    return t.docs.select("document_id", dt.display_date(d).alias("shown"), F.coalesce(F.year(d).cast("string"), F.lit("N/A")).alias("year"))


@query("journal_urls", "PRJ24", """SELECT document_id, 'https://publisher.example/oj/daily-view/L-series/default.html?ojDate=' || strftime(date_of_document, '%d%m%Y') AS journal,
    'https://publisher.example/legal-content/EN/ALL/?uri=OJ:L_' || celex_number AS page, 'https://publisher.example/legal-content/EN/TXT/PDF/?uri=OJ:L_' || celex_number AS pdf FROM docs""")
def journal_urls(t: Tables):
    k = F.col("celex_number")
    return t.docs.select("document_id", ky.journal_url(F.col("date_of_document")).alias("journal"), ky.document_url(k).alias("page"), ky.document_url(k, "PDF").alias("pdf"))


@query("metadata_filtered", "PRJ25", "SELECT document_id, celex_number FROM docs WHERE form = 'src3' AND responsible_body = 'en'")
def metadata_filtered(t: Tables):
    from docloom.plans.recommend import metadata_filter

    return metadata_filter(t.docs, {"form": "src3", "responsible_body": "en"}).select("document_id", "celex_number")


@query("without_test_rows", "PRJ26", """SELECT p_partkey FROM part WHERE NOT (p_partkey % 9 = 0)""")
def without_test_rows(t: Tables):
    k = F.pmod("p_partkey", F.lit(9))
    rows = t.raw("part").withColumns({"id": F.when(k == 0, F.concat(F.lit("Test_"), F.col("p_name"))).otherwise(F.col("p_name")), "key": F.lit(None).cast("string")})
    return rows.filter(~ky.is_test_row(F.col("id"), F.col("key"))).select("p_partkey")


@query("summary_ranges", "PRJ27", """SELECT document_id, CASE WHEN n <= 150 THEN 15 WHEN n <= 300 THEN 50 WHEN n <= 600 THEN 100 WHEN n <= 2500 THEN floor(k * 0.6::DOUBLE)::INT WHEN n <= 20000 THEN 480 ELSE 600 END AS low,
    CASE WHEN n <= 150 THEN 50 WHEN n <= 300 THEN 100 WHEN n <= 600 THEN 200 WHEN n <= 2500 THEN floor(k * 0.8::DOUBLE)::INT WHEN n <= 20000 THEN 600 ELSE 800 END AS high
    FROM (SELECT document_id, total_words AS n, greatest(300, least(floor(total_words * 0.3::DOUBLE)::INT, 600)) AS k FROM docs)""")
def summary_ranges(t: Tables):
    low, high = tx.summary_range(F.col("total_words"))
    return t.docs.select("document_id", low.alias("low"), high.alias("high"))


@query("keyword_budgets", "PRJ28", "SELECT document_id, trunc(greatest(2.0, least(15.0, 2.5::DOUBLE * ln(greatest(total_words, 1)) - 4.77::DOUBLE)))::INT AS budget FROM docs")
def keyword_budgets(t: Tables):
    return t.docs.select("document_id", tx.keyword_budget(F.col("total_words")).alias("budget"))


@query("request_keys", "PRJ29", "SELECT event_id, 'mode:' || event_type || '|top:' || (event_id % 20)::VARCHAR || '|user:' || user_id::VARCHAR AS request_key FROM events")
def request_keys(t: Tables):
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("mode"), F.col("event_type"), F.lit("top"), F.pmod("event_id", F.lit(20)).cast("string"))
    return t.raw("events").select("event_id", ky.request_key(m).alias("request_key"))


@query("requests_to_run", "PRJ30", """WITH latest AS (SELECT max(ts) AS now FROM events)
    SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s, latest WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.ts > latest.now - INTERVAL 24 HOUR)""")
def requests_to_run(t: Tables):
    from docloom.plans.reuse import still_to_run

    e = t.raw("events").withColumn("request_key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    now = e.agg(F.max("ts").alias("m")).scalar()
    requests = e.select("user_id", "event_type", "request_key").distinct()
    return still_to_run(requests, e.withColumnRenamed("ts", "saved_at"), now).select("user_id", "event_type")


@query("profile_queries", "PRJ31", r"""SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND len(w) > 0 THEN array_to_string(w[1:20], ' ') ELSE source || ' ' || lang || ' legal' END AS query_text
    FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def profile_queries(t: Tables):
    text = F.when(F.pmod("doc_id", F.lit(4)) != 0, F.col("text"))
    cats = F.array("source", "lang", F.lit("legal"), F.lit("other"))
    return t.raw("documents").select("doc_id", ky.profile_query(text, cats).alias("query_text"))


@query("industries", "PRJ32", "SELECT industry, count(*) AS clients FROM (SELECT split_part(lower(c_mktsegment) || '_' || c_custkey, '_', 1) AS industry FROM customer) GROUP BY 1")
def industries(t: Tables):
    client = F.concat_ws("_", F.lower("c_mktsegment"), F.col("c_custkey").cast("string"))
    return t.raw("customer").select(ky.industry(client).alias("industry")).groupBy("industry").agg(F.count("*").alias("clients"))


@query("default_descriptions", "PRJ33", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Client profile for ' || id || ' in the ' || split_part(id, '_', 1) || ' industry' ELSE c_name END AS description
    FROM (SELECT c_custkey, c_name, lower(c_mktsegment) || '_' || c_custkey AS id FROM customer)""")
def default_descriptions(t: Tables):
    client = F.concat_ws("_", F.lower("c_mktsegment"), F.col("c_custkey").cast("string"))
    given = F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.col("c_name"))
    return t.raw("customer").select("c_custkey", ky.default_description(given, client).alias("description"))


# -- order and limit --------------------------------------------------------------------------------------------

@query("smallest_documents", "TOP3", "SELECT document_id, total_words FROM docs ORDER BY total_words, document_id LIMIT 25")
def smallest_documents(t: Tables):
    return rk.smallest_first(t.docs.select("document_id", "total_words"), 25)


@query("longest_sections", "TOP4", "SELECT document_id, section_order, word_count FROM secs ORDER BY word_count DESC, document_id, section_order LIMIT 10")
def longest_sections(t: Tables):
    return t.secs.select("document_id", "section_order", "word_count").orderBy(F.col("word_count").desc(), "document_id", "section_order").limit(10)


@query("resumed_page", "TOP5", "SELECT document_id, total_words FROM docs ORDER BY total_words, document_id LIMIT 20 OFFSET 40")
def resumed_page(t: Tables):
    return rk.smallest_first(t.docs.select("document_id", "total_words"), 20, offset=40)


@query("resumed_documents", "TOP5", "SELECT document_id FROM docs WHERE document_id > 120")
def resumed_documents(t: Tables):
    return rk.resume_after(t.docs, 120).select("document_id")


@query("document_tokens", "TXT22", f"""SELECT document_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS token_md5 FROM (SELECT document_id, {tokens_sql('content')} AS t FROM docs)""")
def document_tokens(t: Tables):
    held = t.texts.select("document_id", tx.tokens(F.col("content")).alias("t"))
    return held.select("document_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("token_md5"))


@query("keyword_word_sets", "TXT22", f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ', ' || p_type), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({STOP_SQL})))), ' ') AS words FROM part""")
def keyword_word_sets(t: Tables):
    both = F.concat_ws(", ", "p_name", "p_type")
    return t.raw("part").select("p_partkey", F.array_join(F.sort_array(tx.keyword_words(both)), " ").alias("words"))
