"""Incremental jobs: each stream is run to the end of what is available, then its table is read."""

from pyspark.sql import functions as F

from docloom.session import shared_dir
from docloom.streaming import incremental as inc

from .base import Tables, query


def stream(t: Tables, name: str):
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


def finish(q) -> None:
    q.awaitTermination()


@query("streamed_new_documents", "STR1", "SELECT md5(text) AS celex_number FROM documents GROUP BY 1")
def streamed_new_documents(t: Tables):
    """Arrives in two parts that share keys; the job is started anew for the second."""
    out, mark, source = (shared_dir(t.spark, x) for x in ("new", "mark", "source"))
    rows = t.raw("documents").select("doc_id", F.md5("text").alias("celex_number"))
    for part in (0, 1):
        rows.filter(F.pmod("doc_id", F.lit(2)) == part).unionByName(rows.filter(F.pmod("doc_id", F.lit(5)) == part)).write.mode("append").parquet(source)
        keyed = t.spark.readStream.schema(rows.schema).parquet(source).select("celex_number")
        finish(inc.run_batches(keyed, mark, inc.append_new(out), "append"))
    return inc.read_new(t.spark, out, rows.select("celex_number").schema)


@query("streamed_after_lost_checkpoint", "STR1", "SELECT md5(text) AS celex_number FROM documents GROUP BY 1")
def streamed_after_lost_checkpoint(t: Tables):
    """The job has read half of the documents when its checkpoint is lost; a new one reads all of them into the same table."""
    out, source = shared_dir(t.spark, "new"), shared_dir(t.spark, "source")
    rows = t.raw("documents").select("doc_id", F.md5("text").alias("celex_number"))
    for part in (0, 1):
        rows.filter(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(source)
        keyed = t.spark.readStream.schema(rows.schema).parquet(source).select("celex_number")
        finish(inc.run_batches(keyed, shared_dir(t.spark, "mark"), inc.append_new(out), "append"))
    return inc.read_new(t.spark, out, rows.select("celex_number").schema)


_RATED = ", ".join(f"count(*) FILTER (rating = {r}) AS rated_{r}" for r in range(1, 6))


@query("streamed_ratings", "STR2", f"SELECT document_id, count(*) AS ratings, round(avg(rating), 6) AS avg_rating, {_RATED} FROM feedback GROUP BY 1")
def streamed_ratings(t: Tables):
    base, mark = shared_dir(t.spark, "ratings"), shared_dir(t.spark, "mark")
    rated = stream(t, "events").select(
        F.pmod("event_id", F.lit(t.n_documents)).alias("document_id"), (F.lit(1) + F.least(F.lit(4), F.floor(F.col("value") / 100))).cast("int").alias("rating"))
    table = inc.KeyedTable(t.spark, base, ["document_id"])
    finish(inc.run_batches(inc.running_ratings(rated), mark, table.fold, "update"))
    return table.read()


@query("streamed_daily_counts", "STR3", "SELECT CAST(ts::DATE AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_daily_counts(t: Tables):
    """All days, also those still open."""
    base, mark = shared_dir(t.spark, "daily"), shared_dir(t.spark, "mark")
    events = stream(t, "events").withColumn("at", F.col("ts").cast("timestamp"))
    table = inc.KeyedTable(t.spark, base, ["day", "event_type"])
    finish(inc.run_batches(inc.daily_counts(events, "at", "event_type"), mark, table.fold, "update"))
    return table.read().withColumn("day", F.col("day").cast("string"))


@query("streamed_keyword_upserts", "STR4 SNK4", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def streamed_keyword_upserts(t: Tables):
    base, mark = shared_dir(t.spark, "upserts"), shared_dir(t.spark, "mark")
    """Events arrive in two parts, the newer ones first; the job is started anew for the second."""
    source = shared_dir(t.spark, "source")
    rows = t.raw("events").select("user_id", "event_type", "event_id")
    table = inc.KeyedTable(t.spark, base, ["user_id", "event_type"], ["event_id"])
    for part in (1, 0):
        rows.filter(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(source)
        finish(inc.run_batches(t.spark.readStream.schema(rows.schema).parquet(source), mark, table.fold, "append"))
    return table.read()
