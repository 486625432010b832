"""From pages to stored documents, sections and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as cp
from ..operators import markup as mk
from ..session import materialise


def build_sections(documents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of documents (document_id, html_content) not sectioned yet, and per-document totals with errors."""
    todo = cp.without_sections(documents.filter(F.coalesce(F.trim("html_content"), F.lit("")) != ""), existing)
    parsed = materialise(mk.parse_pages(todo, "document_id", "html_content", mk.UNWANTED_CLASSES), "parsed")
    sections = mk.sections(parsed, "document_id")
    totals = sections.groupBy("document_id").agg(F.count("*").alias("sections"), F.sum("word_count").alias("total_words"))
    report = parsed.select("document_id", "error").join(totals, "document_id", "left").select(
        "document_id", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("total_words", F.lit(0)).alias("total_words"),
        F.coalesce("error", F.when(F.col("sections").isNull(), F.lit("no sections"))).alias("error"),
    )
    return sections, report


def ingest(links: DataFrame, metadata_pages: DataFrame, content_pages: DataFrame, known: DataFrame):
    """One ingest batch: wanted ids, their metadata and content pages, keys already stored.

    ``links``: (document_id, journal_date); pages: (document_id, html). Returns (stored, rejected, counters).
    Fetching pages is not part of it.

    Of several links or pages of an id the largest counts, of several ids with one key the smallest id; the others are
    left out as already processed. Pages are parsed once: what is read from them is written and serves all three results.
    """
    wanted = links.groupBy("document_id").agg(F.max("journal_date").alias("journal_date"))
    one = lambda pages: pages.join(wanted.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.max("html").alias("html"))
    meta = mk.metadata(mk.parse_pages(one(metadata_pages), "document_id"), "document_id")
    text = mk.main_text(mk.parse_pages(one(content_pages), "document_id"), "document_id")
    joined = materialise((
        wanted.join(meta.withColumnRenamed("error", "meta_error"), "document_id", "left")
        .join(text.withColumnRenamed("error", "text_error"), "document_id", "left")
    ), "ingest")
    keyed = joined.filter(F.col("celex_number").isNotNull())
    first = keyed.groupBy("celex_number").agg(F.min("document_id").alias("document_id"))
    fresh = cp.unseen(keyed.join(first, ["celex_number", "document_id"], "left_semi").select(joined.columns), known)
    unread = joined.filter(F.col("celex_number").isNull())
    checked = mk.validate(fresh.unionByName(unread))
    reasons = F.concat("reasons", F.array_compact(F.array("meta_error", "text_error")))
    checked = checked.withColumn("reasons", reasons)
    good, bad = mk.split_valid(checked)
    status = F.when(F.size("reasons") == 0, "success").otherwise("failure")
    counters = checked.groupBy(status.alias("status"), "journal_date").agg(F.count("*").alias("n"))
    return good, bad, counters


def to_corpus(raw: DataFrame) -> dict[str, DataFrame]:
    """Raw nested documents as the corpus tables: ids are stable hashes of key or name, so a rerun gives the same rows.

    A missing name has no id and no row of its own.
    """
    from ..functions import dates as dt

    m = F.col("metadata")
    doc_id = F.xxhash64("metadata.celex_number")
    name_id = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    docs = raw.select(
        doc_id.alias("document_id"), m["celex_number"].alias("celex_number"), m["title"].alias("title"),
        m["identifier"].alias("identifier"), m["eli_uri"].alias("eli_uri"), m["html_url"].alias("html_url"), m["pdf_url"].alias("pdf_url"),
        name_id(m["responsible_body"]).alias("responsible_body_id"), name_id(m["form"]).alias("form_id"),
        dt.parse_date(m["dates"]["Date of document"]).alias("date_of_document"),
        dt.parse_date(m["dates"]["Date of effect"]).alias("date_of_effect"),
        dt.parse_date(m["dates"]["Date of end of validity"]).alias("date_of_end_validity"), "content",
    )
    out = {
        "documents": docs,
        "forms": raw.select(name_id(m["form"]).alias("form_id"), m["form"].alias("form_name")).filter("form_name IS NOT NULL").distinct(),
        "responsible_bodies": raw.select(name_id(m["responsible_body"]).alias("body_id"), m["responsible_body"].alias("body_name")).filter("body_name IS NOT NULL").distinct(),
    }
    for field, dim, key, name in (
        ("authors", "authors", "author_id", "name"),
        ("eurovoc_descriptors", "eurovoc_descriptors", "descriptor_id", "descriptor_name"),
        ("subject_matters", "subject_matters", "subject_id", "subject_name"),
    ):
        rows = raw.select(doc_id.alias("document_id"), F.explode(m[field]).alias(name)).filter(F.col(name).isNotNull()).distinct()
        out[dim] = rows.select(name_id(F.col(name)).alias(key), name).distinct()
        out[f"document_{field}"] = rows.select("document_id", name_id(F.col(name)).alias(key))
    pairs = F.arrays_zip(m["directory_codes"].alias("directory_code"), m["directory_descriptions"].alias("directory_label"))
    codes = raw.select(doc_id.alias("document_id"), F.explode(pairs).alias("p")).select("document_id", "p.directory_code", "p.directory_label").distinct()
    out["directory_codes"] = codes.select(name_id(F.col("directory_code")).alias("directory_id"), "directory_code", "directory_label").distinct()
    out["document_directory_codes"] = codes.select("document_id", name_id(F.col("directory_code")).alias("directory_id"))
    return out
