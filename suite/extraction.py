"""Pages to text, records, links and sections; the ingest batch."""

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import markup as mk
from docloom.plans import ingest as ing
from docloom.session import spread

from .base import Tables, query


def parsed(t: Tables, drop=()):
    return mk.parse_pages(spread(t.raw("pages")), drop=drop)


# Documents rendered as the page shapes the extractors read. The text is escaped, one paragraph per line.
def _escaped(c):
    out = F.regexp_replace(c, "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(out, "<", "&lt;"), ">", "&gt;")


def content_pages(t: Tables):
    lines = F.filter(F.split("content", "\n"), lambda s: tx.strip(s) != "")
    body = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("<p>"), _escaped(s), F.lit("</p>"))), "\n")
    html = F.concat(F.lit('<html><body><div class="navigation">menu</div><div id="TexteOnly">'), body, F.lit("</div></body></html>"))
    return t.texts.select("document_id", html.alias("html"))


def metadata_pages(t: Tables):
    k, i = F.col("celex_number"), F.col("document_id")
    html = F.concat(
        F.lit('<html><body><p class="DocumentTitle">Document '), k, F.lit('</p><p id="title">Title '), i.cast("string"), F.lit("</p><p>"), F.col("lang"),
        F.lit('</p><a href="http://data.europa.eu/eli/'), k, F.lit('">eli</a><dl class="NMetadata"><dt>Date of document: </dt><dd>'),
        F.coalesce(F.date_format("date_of_document", "dd/MM/yyyy"), F.lit("")), F.lit("; adopted</dd><dt>Author: </dt><dd>"), F.col("source"), F.lit(" , "), F.col("lang"),
        F.lit("</dd><dt>Form: </dt><dd>"), F.coalesce("form", F.lit("")), F.lit("</dd><dt>EUROVOC descriptor: </dt><dd><ul><li>"), F.col("lang"), F.lit("</li><li>"), F.col("source"),
        F.lit("</li></ul></dd><dt>Directory code: </dt><dd><ul><li>03.50 <span>Agri</span><span>"), F.col("source"), F.lit("</span></li></ul></dd></dl></body></html>"))
    return t.texts.select("document_id", html.alias("html"))


@query("page_main_texts", "EXT1", r"""SELECT document_id, md5(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda s: trim(s, E' \t\r\n')), lambda s: s <> ''), chr(10))) AS text_md5,
    CAST(NULL AS VARCHAR) AS error FROM docs WHERE trim(content, E' \t\r\n') <> ''""")
def page_main_texts(t: Tables):
    out = mk.main_text(mk.parse_pages(content_pages(t), "document_id"), "document_id")
    return out.filter("full_text <> ''").select("document_id", F.md5("full_text").alias("text_md5"), "error")


@query("raw_page_texts", "EXT1")
def raw_page_texts(t: Tables):
    return mk.main_text(parsed(t), fallback_tags=("article", "body"), joiner=" ").select("page_id", tx.word_count(F.col("full_text")).alias("words"), "error")


@query("page_metadata", "EXT2", """SELECT document_id, celex_number, 'Title ' || document_id AS title, lang AS identifier, 'http://data.europa.eu/eli/' || celex_number AS eli_uri, coalesce(form, '') AS form, source || '|' || lang AS authors,
    lang || '|' || source AS eurovoc, '03.50' AS codes, 'Agri / ' || source AS labels, CAST(date_of_document AS VARCHAR) AS dated FROM docs""")
def page_metadata(t: Tables):
    rec = mk.with_dates(mk.metadata(mk.parse_pages(metadata_pages(t), "document_id"), "document_id"))
    show = lambda c: F.array_join(c, "|")
    return rec.select("document_id", "celex_number", "title", "identifier", "eli_uri", "form", show("authors").alias("authors"), show("eurovoc_descriptors").alias("eurovoc"),
                      show("directory_codes").alias("codes"), show("directory_descriptions").alias("labels"), F.col("date_of_document").cast("string").alias("dated"))


@query("page_links", "EXT3", """SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<a [^>]*href=')) FROM pages) GROUP BY 1""")
def page_links(t: Tables):
    return mk.all_links(parsed(t)).groupBy("page_id").agg(F.count("*").alias("links"))


@query("journal_document_links", "EXT3 PRJ9", """SELECT day, document_id, 'https://publisher.example/legal-content/EN/TXT/?uri=OJ:L_' || document_id AS url, 'doc ' || event_id AS title FROM
    (SELECT CAST(ts::DATE AS VARCHAR) AS day, event_id, '2024' || lpad((event_id * 7 % 99999)::VARCHAR, 5, '0') AS document_id FROM events WHERE event_type = 'view') WHERE substr(document_id, 5, 1) <> '9'""")
def journal_document_links(t: Tables):
    """View events laid out as one journal page per day and user group."""
    e = t.raw("events").filter("event_type = 'view'")
    doc = F.concat(F.lit("2024"), F.lpad(F.pmod(F.col("event_id") * 7, F.lit(99999)).cast("string"), 5, "0"))
    a = F.concat(F.lit('<a href="./../../../legal-content/EN/TXT/?uri=OJ:L_'), doc, F.lit('">doc '), F.col("event_id").cast("string"), F.lit("</a>"))
    pages = e.select("event_id", F.to_date("ts").cast("string").alias("day"), F.concat(F.lit('<div id="MainContent"><p>'), a, F.lit("</p></div>")).alias("html"))
    links = mk.document_links(mk.parse_pages(spread(pages), "event_id"), "event_id")
    return links.join(pages.select("event_id", "day"), "event_id").select("day", "document_id", "url", "title")


def sectioned_pages(t: Tables):
    """Documents as sectioned pages: head, preamble, articles line by line, one table, a footnote."""
    lines = F.filter(F.split("content", "\n"), lambda s: tx.strip(s) != "")
    arts = F.transform(lines, lambda s, i: F.concat(F.lit('<p class="oj-ti-art">Article '), (i + 1).cast("string"), F.lit("</p><p>"), _escaped(s), F.lit("</p>")))
    html = F.concat(
        F.lit('<div class="eli-main-title"><p>Act number '), F.col("document_id").cast("string"), F.lit('</p></div><div class="eli-preamble">Whereas '), F.col("lang"),
        F.lit('</div><div class="body">'), F.array_join(arts, ""), F.lit('<p class="oj-note">a note</p></div><div class="body"><p class="oj-ti-section">Annex list</p>'
        '<table><col width="4%"/><col width="96%"/><tr><td>(1)</td><td>first '), F.col("source"), F.lit("</td></tr></table></div>"))
    return t.texts.select("document_id", html.alias("html_content"))


@query("page_sections", "EXT4 EXT5", """WITH l AS (SELECT document_id, list_filter(string_split(content, chr(10)), lambda s: trim(s, E' \\t\\r\\n') <> '') AS l FROM docs), a AS (SELECT document_id, unnest(l) AS s FROM l), g AS (SELECT document_id, count(*) AS n FROM a WHERE regexp_matches(s, '[a-zA-Z]{2,}') GROUP BY 1)
    SELECT document_id, 'header' AS section_type, 1 AS n, 'Act number ' || document_id AS sample FROM docs UNION ALL SELECT document_id, 'preamble', 1, 'Whereas ' || lang FROM docs UNION ALL SELECT document_id, 'oj-ti-section', 1, '(1) first ' || source FROM docs
    UNION ALL SELECT document_id, 'oj-ti-art', n, 'article' FROM g""")
def page_sections(t: Tables):
    out = mk.sections(mk.parse_pages(sectioned_pages(t), "document_id", "html_content", mk.UNWANTED_CLASSES), "document_id")
    sample = F.when(F.col("section_type") == "oj-ti-art", "article").otherwise(F.col("content"))
    return out.groupBy("document_id", "section_type").agg(F.count("*").cast("int").alias("n"), F.max(sample).alias("sample"))


@query("section_build", "EXT6")
def section_build(t: Tables):
    existing = t.raw("labels").select(F.col("doc_id").alias("document_id"))
    return ing.build_sections(sectioned_pages(t), existing)[1]


@query("section_build_coverage", "EXT6 JN6", "SELECT count(*) AS documents, 0 AS failed FROM docs WHERE document_id NOT IN (SELECT doc_id FROM labels)")
def section_build_coverage(t: Tables):
    existing = t.raw("labels").select(F.col("doc_id").alias("document_id"))
    report = ing.build_sections(sectioned_pages(t), existing)[1]
    return report.agg(F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).cast("int").alias("failed"))


def ingest_batch(t: Tables):
    links = t.docs.select("document_id", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("document_id", F.lit(30)).cast("int")).alias("journal_date"))
    meta = metadata_pages(t).withColumn("html", F.when(F.pmod("document_id", F.lit(9)) != 0, F.col("html")).otherwise(F.lit("<p>gone</p>")))
    known = t.docs.join(t.raw("labels").select(F.col("doc_id").alias("document_id")), "document_id").select("celex_number")
    return ing.ingest(links, meta, content_pages(t), known)


@query("ingested_documents", "EXT7", """SELECT document_id, celex_number FROM docs WHERE document_id NOT IN (SELECT doc_id FROM labels) AND document_id % 9 <> 0""")
def ingested_documents(t: Tables):
    return ingest_batch(t)[0].select("document_id", "celex_number")


@query("ingest_status_counts", "EXT7 AGG30", """SELECT CASE WHEN document_id % 9 <> 0 THEN 'success' ELSE 'failure' END AS status, CAST(DATE '2024-01-01' + (document_id % 30)::INT AS VARCHAR) AS journal_date, count(*) AS n
    FROM docs WHERE document_id % 9 = 0 OR document_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1, 2""")
def ingest_status_counts(t: Tables):
    return ingest_batch(t)[2].withColumn("journal_date", F.col("journal_date").cast("string"))
