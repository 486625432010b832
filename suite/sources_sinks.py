"""Readers and writers over data derived from the driver tables."""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import dates as dt
from docloom.functions import keys as ky
from docloom.functions import maps as mp
from docloom.functions import text as tx
from docloom.plans import sweep as sw
from docloom.session import shared_dir
from docloom.sources import readers as rd
from docloom.sources import schemas as sch
from docloom.sources import writers as wr

from .base import Tables, query, write_files


def raw_documents(t: Tables):
    """Driver documents in the nested raw shape."""
    d = t.docs
    shown = F.date_format("date_of_document", "dd/MM/yyyy")
    meta = F.struct(
        F.when(F.pmod("document_id", F.lit(17)) != 0, F.col("celex_number")).alias("celex_number"), F.col("title").alias("title"),
        F.struct(shown.alias("Date of document")).alias("dates"), F.array("source").alias("authors"), F.col("lang").alias("responsible_body"),
        F.col("form").alias("form"), F.array("source", "lang").alias("subject_matters"), F.array("lang").alias("eurovoc_descriptors"),
        F.array("source").alias("directory_codes"), F.array("lang").alias("directory_descriptions"))
    return d.select(meta.alias("metadata"), "content")


FILE_CHARS = 1 << 20  # of documents in one JSON file; a longer document has a file of its own


def json_files(batches):
    """Rows of JSON documents to rows of JSON arrays, each of at most FILE_CHARS characters or one document."""
    held, size = [], 0
    for batch in batches:
        for j in batch.column(0):
            j = j.as_py()
            if held and size + len(j) > FILE_CHARS:
                yield pa.record_batch([pa.array(["[" + ",\n".join(held) + "]"])], names=["value"])
                held, size = [], 0
            held.append(j)
            size += len(j)
    if held:
        yield pa.record_batch([pa.array(["[" + ",\n".join(held) + "]"])], names=["value"])


@query("json_documents", "SRC1", """SELECT celex_number, form, CAST(date_of_document AS VARCHAR) AS dated, length_chars FROM docs WHERE document_id % 17 <> 0""")
def json_documents(t: Tables):
    """Files of a few documents each (JSON arrays over several lines), among them files that cannot be read."""
    path = shared_dir(t.spark, "raw")
    held = raw_documents(t).select(F.to_json(F.struct("metadata", "content"), {"pretty": "true"}).alias("j"))
    broken = t.spark.createDataFrame([('{"metadata": {"celex',), ("",)], "value string")
    # One row is one file. Documents are taken as they come: no shuffle, and files grow in number, not in size.
    held.mapInArrow(json_files, "value string").unionByName(broken).write.option("maxRecordsPerFile", 1).text(path)
    back = rd.read_raw_documents(t.spark, path, "*.txt")
    return back.select("metadata.celex_number", "metadata.form", dt.parse_date(F.col("metadata.dates.`Date of document`")).cast("string").alias("dated"), F.length("content").cast("long").alias("length_chars"))


def stored(t: Tables):
    return t.docs.select(F.col("celex_number").alias("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("document_id", F.lit(90)).cast("int")).alias("journal_date"), "content")


_STORED_SQL = "(SELECT celex_number AS doc_id, DATE '2024-01-01' + (document_id % 90)::INT AS journal_date, content FROM docs)"


@query("stored_documents", "SNK1", f"SELECT doc_id, year(journal_date)::INT AS year, month(journal_date)::INT AS month, strftime(journal_date, '%Y%m%d') AS journal_id, md5(content) AS content_md5 FROM {_STORED_SQL}")
def stored_documents(t: Tables):
    path = shared_dir(t.spark, "store")
    wr.store_documents(stored(t), path)
    back = t.spark.read.parquet(path)
    return back.select("doc_id", "year", "month", F.col("journal_id").cast("string").alias("journal_id"), F.md5("content").alias("content_md5"))


@query("loaded_documents", "SRC2", f"SELECT doc_id, strftime(journal_date, '%Y%m%d') AS journal_id FROM {_STORED_SQL} WHERE doc_id IN (SELECT celex_number FROM docs JOIN labels l ON l.doc_id = document_id WHERE quality = 1)")
def loaded_documents(t: Tables):
    path = shared_dir(t.spark, "store")
    wr.store_documents(stored(t), path)
    back = t.spark.read.parquet(path).withColumn("journal_id", F.col("journal_id").cast("string"))
    wanted = t.raw("labels").filter("quality = 1").select(F.col("doc_id").alias("document_id")).join(t.docs, "document_id")
    keys = wr.with_store_columns(wanted.select(F.col("celex_number").alias("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("document_id", F.lit(90)).cast("int")).alias("journal_date")))
    return rd.load_documents(back, keys).select("doc_id", "journal_id")


@query("corpus_tables", "SRC3", """WITH k AS (SELECT * FROM docs WHERE document_id % 17 <> 0) SELECT 'authors' AS table_name, count(DISTINCT source) AS n, count(DISTINCT source) AS ids FROM k UNION ALL SELECT 'documents', count(*), count(*) FROM k
    UNION ALL SELECT 'document_authors', count(*), count(*) FROM k UNION ALL SELECT 'document_subject_matters', count(*) * 2, count(*) FROM k UNION ALL SELECT 'forms', count(DISTINCT form), count(DISTINCT form) FROM k
    UNION ALL SELECT 'responsible_bodies', count(DISTINCT lang), count(DISTINCT lang) FROM k UNION ALL SELECT 'subject_matters', count(DISTINCT v), count(DISTINCT v) FROM (SELECT source AS v FROM k UNION ALL SELECT lang FROM k)
    UNION ALL SELECT 'eurovoc_descriptors', count(DISTINCT lang), count(DISTINCT lang) FROM k UNION ALL SELECT 'document_eurovoc_descriptors', count(*), count(*) FROM k
    UNION ALL SELECT 'directory_codes', count(*), count(DISTINCT source) FROM (SELECT DISTINCT source, lang FROM k) UNION ALL SELECT 'document_directory_codes', count(*), count(*) FROM k
    UNION ALL SELECT 'document_sections', count(*), count(DISTINCT document_id) FROM secs WHERE document_id % 17 <> 0 UNION ALL SELECT 'document_keywords', count(*), count(DISTINCT document_id) FROM kws WHERE document_id % 17 <> 0""")
def corpus_tables(t: Tables):
    """All 13 relational tables, written, registered with their declared schemas and counted through the views."""
    from docloom.plans.ingest import to_corpus

    path = shared_dir(t.spark, "raw")
    raw_documents(t).write.json(path)
    raw = t.spark.read.schema(sch.RAW_DOCUMENT_DDL).json(path)
    tables = to_corpus(raw.filter(F.col("metadata.celex_number").isNotNull()))
    key = t.docs.filter("document_id % 17 <> 0").select("document_id", F.xxhash64("celex_number").alias("id"))
    own = lambda df: df.join(key, "document_id").withColumn("document_id", F.col("id"))
    tables["document_sections"] = own(t.secs).select(F.xxhash64("document_id", "section_order").alias("section_id"), "document_id", "content", "section_type", "section_order", F.col("word_count").cast("int").alias("word_count"))
    tables["document_keywords"] = own(t.kws).select(F.xxhash64("document_id", "keyword").alias("id"), "document_id", "keyword", "score")
    base, out = shared_dir(t.spark, "corpus"), None
    for name, df in tables.items():
        wr.replace_table(df, f"{base}/{name}")
    first = {"documents": "document_id", "forms": "form_id", "responsible_bodies": "body_id", "authors": "author_id", "eurovoc_descriptors": "descriptor_id", "subject_matters": "subject_id", "directory_codes": "directory_id"}
    for name in rd.register_corpus(t.spark, base):
        n = t.spark.table(name).agg(F.count("*").alias("n"), F.count_distinct(first.get(name, "document_id")).alias("ids")).select(F.lit(name).alias("table_name"), "n", "ids")
        out = n if out is None else out.unionByName(n)
    return out


@query("normalised_profiles", "SRC4", """SELECT 'u' || user_id AS user_id, 'expert ' || user_id AS expert_description, CASE WHEN user_id % 3 < 2 THEN n ELSE 0 END AS history FROM (SELECT user_id, count(*) AS n FROM history GROUP BY 1)""")
def normalised_profiles(t: Tables):
    h = t.history.groupBy("user_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("h"))
    k, u = F.pmod("user_id", F.lit(3)), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    desc = F.concat(F.lit("expert "), F.col("user_id").cast("string"))
    parts = F.struct(F.struct(desc.alias("description")).alias("expert_profile"), F.col("h").alias("historical_documents"))
    body = F.when(k == 0, F.to_json(F.struct(u.alias("user_id"), parts.alias("profile")))).when(
        k == 1, F.to_json(F.struct(F.struct(u.alias("id"), parts.alias("profile_components")).alias("client")))).otherwise(
        F.to_json(F.struct(u.alias("id"), desc.alias("expert_description"))))
    path = shared_dir(t.spark, "profiles")
    write_files(h.select(F.concat(u, F.lit(".json")).alias("file"), body.alias("value")), path)
    return rd.read_profiles(t.spark, path).select("user_id", "expert_description", F.size("historical_documents").cast("long").alias("history"))


@query("feedback_round_trip", "SRC6", "SELECT user_id::VARCHAR AS user_id, document_id::VARCHAR AS document_id, count(*) AS n, sum(rating)::BIGINT AS rating FROM feedback WHERE event_type <> 'error' GROUP BY 1, 2")
def feedback_round_trip(t: Tables):
    path = shared_dir(t.spark, "feedback")
    s = lambda c: F.col(c).cast("string")
    rating = F.when(F.col("event_type") == "error", 9).otherwise(F.col("rating"))
    rows = t.feedback.select(s("user_id").alias("user_id"), s("document_id").alias("document_id"), F.lit('a "quoted", query').alias("query"), rating.cast("int").alias("rating"),
                             F.lit("rating").alias("feedback_type"), s("ts").alias("timestamp"), F.to_json(F.create_map(F.lit("v"), F.col("value"))).alias("additional_data"))
    wr.append_feedback(rows, path)
    return rd.read_feedback(t.spark, path).groupBy("user_id", "document_id").agg(F.count("*").alias("n"), F.sum("rating").alias("rating"))


@query("sweep_rows", "SRC10 EVL14", """SELECT label::INT AS config_id, round(count(*)::DOUBLE, 6) AS score FROM vecs GROUP BY 1""")
def sweep_rows(t: Tables):
    """Per-label counts written as one sweep document and flattened again."""
    n = t.vecs.groupBy("label").agg(F.count("*").cast("double").alias("score"))
    one = n.agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "score"))), lambda r: F.struct(
        F.create_map(F.lit("text"), F.lit(1.0)).alias("weights"), r["score"].alias("score"), F.create_map(F.lit("ndcg@10"), r["score"]).alias("metrics"))).alias("all_results"))
    path = shared_dir(t.spark, "sweep")
    one.withColumn("metric", F.lit("ndcg@10")).write.json(path)
    return rd.read_sweep(t.spark, path).select("config_id", "score")


@query("weight_group_round_trip", "SRC10", """SELECT 'label ' || label AS "group", 'group "' || grp || '"' AS name, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY label) AS weight FROM vecs GROUP BY label, grp""")
def weight_group_round_trip(t: Tables):
    """For each label the share of each group as its weight, written as one document and read back."""
    n = t.vecs.groupBy("label", F.pmod("doc_id", F.lit(3)).alias("grp")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("label"))
    named = n.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("group"), F.concat(F.lit('group "'), F.col("grp").cast("string"), F.lit('"')).alias("name"), share.alias("weight"))
    path = shared_dir(t.spark, "weights")
    wr.write_weight_groups(named, path)
    return rd.read_weight_groups(t.spark, path)


@query("updated_summaries", "SNK2", r"""SELECT document_id, CASE WHEN document_id % 7 = 0 THEN title ELSE summary END AS summary, total_words FROM summarised""")
def updated_summaries(t: Tables):
    """Every document to update has two updates; the later one counts."""
    todo = t.summarised.filter(F.col("summary").isNull())
    final = todo.select("document_id", F.col("title").alias("summary"), F.lit(2).alias("seq"))
    draft = todo.select("document_id", F.concat(F.lit("zz draft "), F.col("title")).alias("summary"), F.lit(1).alias("seq"))
    return wr.update_fields(t.summarised, final.unionByName(draft), "document_id", ["summary"], ["seq"]).select("document_id", "summary", "total_words")


@query("upserted_sections", "SNK3", """SELECT document_id, section_order, CASE WHEN document_id % 5 = 0 THEN md5('new ' || content) ELSE md5(content) END AS content_md5 FROM secs
    UNION ALL SELECT document_id, -1, md5('added') FROM docs""")
def upserted_sections(t: Tables):
    base = t.secs.select("document_id", "section_order", "content")
    changed = base.filter(F.pmod("document_id", F.lit(5)) == 0).withColumn("content", F.concat(F.lit("new "), F.col("content")))
    added = t.docs.select("document_id", F.lit(-1).alias("section_order"), F.lit("added").alias("content"))
    once = wr.upsert(base, changed.unionByName(added), ["document_id", "section_order"], ["content"])
    return once.select("document_id", "section_order", F.md5("content").alias("content_md5"))


@query("bucketed_upserts", "SNK3 SNK5", """SELECT doc_id, round(CASE WHEN doc_id % 50 = 7 THEN 3 * vector[1] WHEN doc_id < 40 THEN 2 * vector[1] ELSE vector[1] END, 6) AS first_cell, true AS kept_file FROM vecs
    UNION ALL SELECT -1 - g, 0.5::DOUBLE, true FROM range(3) r(g)""")
def bucketed_upserts(t: Tables):
    """Vectors in a bucketed table: two batches of changes, the second given twice. ``kept_file``: no file outside the touched buckets changed."""
    from docloom.sources.bucketed import BucketedTable

    v = t.vecs.select("doc_id", F.get("vector", 0).alias("cell"))
    table = BucketedTable(t.spark, shared_dir(t.spark, "bucketed"), ["doc_id"], v.schema, 128)
    table.upsert(v, ["cell"])
    scaled = lambda rows, by: rows.withColumn("cell", F.col("cell") * by)
    first = scaled(v.where("doc_id < 40"), 2)
    second = scaled(v.where("doc_id % 50 = 7"), 3).unionByName(t.spark.range(3).select((-1 - F.col("id")).alias("doc_id"), F.lit(0.5).alias("cell")))
    kept = True
    for batch in (first, second, second):
        before, touched = table.manifest(), set(table.touched(batch))
        table.upsert(batch, ["cell"])
        after = table.manifest()
        kept &= all(after[b] == x for b, x in before.items() if b not in touched) and all(after[b] == table.version() for b in touched)
    return table.read().select("doc_id", F.round("cell", 6).alias("first_cell"), F.lit(kept).alias("kept_file"))


@query("upserted_keywords", "SNK4", """SELECT document_id, keyword, CASE WHEN score >= 0.1 THEN 1.0::DOUBLE ELSE score END AS score FROM kws""")
def upserted_keywords(t: Tables):
    new = t.kws.filter("score >= 0.1").withColumn("seq", F.lit(2)).withColumn("score", F.lit(1.0))
    early = new.withColumns({"seq": F.lit(1), "score": F.lit(0.5)})
    return wr.upsert(t.kws, new.unionByName(early), ["document_id", "keyword"], ["seq"]).select("document_id", "keyword", "score")


@query("upserted_vectors", "SNK5", "SELECT doc_id, round(CASE WHEN label = 3 THEN 2 * vector[1] ELSE vector[1] END, 6) AS first_cell FROM vecs")
def upserted_vectors(t: Tables):
    from docloom.plans.index import upsert_vectors

    v = t.vecs.select("doc_id", "vector", "features")
    new = t.vecs.filter("label = 3").select("doc_id", F.transform("vector", lambda x: x * 2).alias("vector"), "features")
    return upsert_vectors(v, new).select("doc_id", F.round(F.get("vector", 0), 6).alias("first_cell"))


@query("rebuilt_sections", "SNK6", "SELECT document_id, section_order, word_count FROM secs")
def rebuilt_sections(t: Tables):
    path = shared_dir(t.spark, "sections")
    lean = t.secs.select("document_id", "section_order", "word_count")
    wr.replace_table(lean.filter("word_count > 50"), path)
    wr.replace_table(lean, path)
    return t.spark.read.parquet(path)


@query("saved_profiles", "SNK7", """WITH old AS (SELECT user_id, min(event_type) AS body, min(ts) AS at FROM events WHERE event_type <> 'signup' GROUP BY 1), new AS (SELECT user_id, 'new' AS body, max(ts) AS at FROM events WHERE event_type = 'signup' AND value > 50 GROUP BY 1)
    SELECT user_id, coalesce(new.body, old.body) AS body, CAST(coalesce(old.at, new.at)::DATE AS VARCHAR) AS created, CAST(coalesce(new.at, old.at)::DATE AS VARCHAR) AS updated FROM old FULL JOIN new USING (user_id)""")
def saved_profiles(t: Tables):
    """Every sign-up is an update of its own; the last of a user counts."""
    e = t.raw("events")
    old = e.filter("event_type <> 'signup'").groupBy("user_id").agg(F.min("event_type").alias("body"), F.min("ts").alias("created_at"), F.min("ts").alias("updated_at"))
    signups = e.filter("event_type = 'signup' and value > 50").withColumn("last", F.max("ts").over(Window.partitionBy("user_id")))
    new = signups.select("user_id", F.when(F.col("ts") == F.col("last"), "new").otherwise("old").alias("body"), F.col("ts").alias("updated_at"))
    out = wr.save_profiles(old, new)
    day = lambda c: F.to_date(c).cast("string")
    return out.select("user_id", "body", day("created_at").alias("created"), day("updated_at").alias("updated"))


@query("exported_results", "SNK8", """SELECT query_id, rank, score, celex_number, CASE WHEN trim(title) <> '' THEN title ELSE 'EU Regulation ' || celex_number END AS title,
    CASE substr(celex_number, 6, 1) WHEN 'R' THEN 'regulation' WHEN 'L' THEN 'directive' WHEN 'D' THEN 'decision' WHEN 'Q' THEN 'recommendation' ELSE 'other' END AS document_type,
    'https://publisher.example/legal-content/EN/TXT/?uri=CELEX:' || celex_number AS url FROM top10 JOIN (SELECT document_id AS doc_id, celex_number, title FROM docs) d USING (doc_id)""")
def exported_results(t: Tables):
    """Written as an export and read back."""
    from .scoring import sims10

    path = shared_dir(t.spark, "export")
    table = wr.result_table(sims10(t), t.docs).filter(F.col("celex_number").isNotNull())
    wr.export_csv(table, path)
    return rd.read_export(t.spark, path, table.schema)


@query("exported_stats", "SNK9", "SELECT lang, count(*) AS n, sum(total_words)::BIGINT AS words FROM docs GROUP BY 1")
def exported_stats(t: Tables):
    path = shared_dir(t.spark, "stats")
    wr.export_csv(t.docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("total_words").alias("words")), path)
    return t.spark.read.schema("lang string, n long, words long").option("header", True).csv(path)


@query("stored_byte_totals", "SNK10")
def stored_byte_totals(t: Tables):
    return wr.stored_bytes(t.spark, t.dir)


@query("edited_profiles", "SNK11", """WITH h AS (SELECT user_id, count(DISTINCT d) AS history FROM (SELECT user_id, doc_id AS d FROM history UNION ALL SELECT user_id, event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'click') GROUP BY 1),
    x AS (SELECT user_id, max_by('text ' || event_id, event_id) AS expert_description FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT h.user_id::VARCHAR AS user_id, coalesce(x.expert_description, 'first') AS expert_description, history FROM h LEFT JOIN x USING (user_id)""")
def edited_profiles(t: Tables):
    u = F.col("user_id").cast("string").alias("user_id")
    pref = "map<string,map<string,double>>"
    base = t.history.groupBy("user_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("historical_documents")).select(
        u, F.lit("first").alias("expert_description"), "historical_documents", F.lit(None).cast(pref).alias("preferences"))
    e = t.raw("events")
    text = e.filter("event_type = 'signup'").select(u, F.col("event_id").alias("seq"), F.lit("set_text").alias("op"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"))
    add = e.filter("event_type = 'click'").select(u, F.col("event_id").alias("seq"), F.lit("add_history").alias("op"), F.pmod("event_id", F.lit(t.n_vectors)).cast("string").alias("text"))
    out = wr.apply_profile_edits(base, text.unionByName(add).withColumn("preferences", F.lit(None).cast(pref)))
    return out.select("user_id", "expert_description", F.size("historical_documents").cast("long").alias("history"))
