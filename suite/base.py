"""Registry, the logical tables derived from the driver tables, and the same derivations as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.session import spread


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name with its SQL and the inventory ids it covers."""

    def wrap(fn: Callable[["Tables"], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Entry(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), with_ctes(sql) if sql else None, tuple(covers.split()))
        return fn

    return wrap


class Tables:
    """Driver tables and what is derived from them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self._documents(self.raw("documents"))

    @cached_property
    def texts(self) -> DataFrame:
        """Documents for heavy per-row work, on all cores whatever the file layout."""
        return self._documents(spread(self.raw("documents")))

    @staticmethod
    def _documents(raw: DataFrame) -> DataFrame:
        i = F.col("doc_id")
        letter = F.get(F.array(*(F.lit(x) for x in "RLDQX")), F.pmod(i, F.lit(5)).cast("int"))
        return raw.select(
            i.alias("document_id"),
            F.concat(F.lit("3"), (F.pmod(i, F.lit(25)) + 2000).cast("string"), letter, F.lpad(i.cast("string"), 8, "0")).alias("celex_number"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("content"),
            F.when(F.pmod(i, F.lit(11)) != 0, F.col("source")).alias("form"),
            F.col("lang").alias("responsible_body"),
            F.when(F.pmod(i, F.lit(13)) != 0, F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(i, F.lit(3650)).cast("int"))).alias("date_of_document"),
            tx.word_count(F.col("text")).cast("long").alias("total_words"),
            F.length("text").cast("long").alias("length_chars"),
            "source", "lang",
        )

    @cached_property
    def secs(self) -> DataFrame:
        kind = F.when(F.col("section_order") == 0, "header").when(F.col("section_order") == 1, "preamble").otherwise("main")
        rows = self.texts.select("document_id", F.posexplode(F.split("content", "\n")).alias("section_order", "content"))
        return rows.withColumns({"section_type": kind, "word_count": tx.word_count(F.col("content")).cast("long")})

    @cached_property
    def summarised(self) -> DataFrame:
        """Documents with a 20-word summary; every seventh has none yet."""
        s = F.when(F.pmod("document_id", F.lit(7)) != 0, tx.first_words(F.col("content"), 20))
        return self.texts.withColumn("summary", s)

    @cached_property
    def kws(self) -> DataFrame:
        toks = tx.tokens(F.col("content"), min_len=4)
        held = self.texts.select("document_id", toks.alias("t")).select("document_id", F.size("t").alias("n"), F.explode(tx.term_counts(F.col("t"))).alias("c"))
        return held.select("document_id", F.col("c.term").alias("keyword"), F.round(F.col("c.tf") / F.col("n"), 6).alias("score"))

    @cached_property
    def vecs(self) -> DataFrame:
        i = F.col("vec_id")
        label = F.concat(F.lit("l"), F.col("label").cast("string"))
        group = F.concat(F.lit("g"), F.pmod(i, F.lit(3)).cast("string"))
        return self.raw("embeddings").select(
            i.alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"), "label",
            F.create_map(F.lit("form"), F.array(label), F.lit("subject_matters"), F.array(label, group)).alias("features"),
            F.when(F.pmod(i, F.lit(13)) != 0, F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(i * 7, F.lit(3650)).cast("int"))).alias("date"),
        )

    @cached_property
    def n_vectors(self) -> int:
        """Ids run from 0, so events refer to all vectors, however many there are."""
        return self.raw("embeddings").count()

    @cached_property
    def n_documents(self) -> int:
        return self.raw("documents").count()

    @cached_property
    def history(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "purchase")
        return e.select("user_id", F.pmod("event_id", F.lit(self.n_vectors)).alias("doc_id")).distinct()

    @cached_property
    def experts(self) -> DataFrame:
        users = self.raw("events").select("user_id").distinct().withColumn("doc_id", F.pmod("user_id", F.lit(self.n_vectors)))
        return users.join(self.vecs.select("doc_id", "vector", "features"), "doc_id").drop("doc_id")

    @cached_property
    def feedback(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            "user_id", F.pmod("event_id", F.lit(self.n_documents)).alias("document_id"),
            (F.lit(1) + F.least(F.lit(4), F.floor(F.col("value") / 100))).cast("int").alias("rating"),
            "event_id", "event_type", F.to_date("ts").alias("day"), "ts", "value",
        )

    @cached_property
    def links(self) -> DataFrame:
        """Document-author relation: orders and their suppliers."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("author_id")).distinct()


def write_files(lines: DataFrame, path: str) -> None:
    """Rows (file, value) as text files of these names; a file's lines are one task's, for small files."""
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{key[0]}", compression=None) as out:
            out.write("\n".join(rows["value"].dropna()).encode())
        return pd.DataFrame({"file": [key[0]]})

    lines.groupBy("file").applyInPandas(write, "file string").count()


STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
WORDS_SQL = r"len(regexp_extract_all({0}, '\S+'))"


def words_sql(c: str) -> str:
    return WORDS_SQL.format(c)


def tokens_sql(c: str, min_len: int = 1) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), "
        rf"lambda t: len(t) >= {min_len} AND t NOT IN ({STOP_SQL}))"
    )


CTES = {
    "docs": rf"""SELECT doc_id AS document_id,
        '3' || (2000 + doc_id % 25)::VARCHAR || (['R','L','D','Q','X'])[(doc_id % 5)::INT + 1] || lpad(doc_id::VARCHAR, 8, '0') AS celex_number,
        split_part(text, chr(10), 1) AS title, text AS content,
        CASE WHEN doc_id % 11 <> 0 THEN source END AS form, lang AS responsible_body,
        CASE WHEN doc_id % 13 <> 0 THEN DATE '2015-01-01' + (doc_id % 3650)::INT END AS date_of_document,
        {words_sql('text')}::BIGINT AS total_words, length(text)::BIGINT AS length_chars, source, lang FROM documents""",
    "secs": rf"""SELECT document_id, (pos - 1)::INT AS section_order, content,
        CASE pos WHEN 1 THEN 'header' WHEN 2 THEN 'preamble' ELSE 'main' END AS section_type, {words_sql('content')}::BIGINT AS word_count
        FROM (SELECT document_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS pos
              FROM (SELECT document_id, string_split(content, chr(10)) AS l FROM docs))""",
    "summarised": r"""SELECT *, CASE WHEN document_id % 7 <> 0 THEN
        array_to_string(regexp_extract_all(content, '\S+')[1:20], ' ') END AS summary FROM docs""",
    "toks": f"SELECT document_id, {tokens_sql('content')} AS toks FROM docs",
    "kws": f"""SELECT document_id, keyword, round(count(*)::DOUBLE / any_value(n), 6) AS score
        FROM (SELECT document_id, unnest(t) AS keyword, len(t) AS n FROM (SELECT document_id, {tokens_sql('content', 4)} AS t FROM docs))
        GROUP BY document_id, keyword""",
    "vecs": """SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vector, label, vec_id % 3 AS grp,
        CASE WHEN vec_id % 13 <> 0 THEN DATE '2015-01-01' + ((vec_id * 7) % 3650)::INT END AS date FROM embeddings""",
    "judgements": """SELECT q.doc_id AS query_id, d.doc_id, 1.0::DOUBLE AS rel FROM vecs q JOIN vecs d ON q.label = d.label AND q.doc_id <> d.doc_id""",
    "sims": """SELECT q.doc_id AS query_id, d.doc_id, round(list_cosine_similarity(q.vector, d.vector), 6) AS text_score,
        ((q.label = d.label)::INT + (q.grp = d.grp)::INT) AS shared, (q.label = d.label)::INT AS same_label, d.date
        FROM vecs q JOIN vecs d ON q.doc_id <> d.doc_id""",
    "top10": """SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, text_score AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, doc_id) AS rank FROM sims) WHERE rank <= 10""",
    "cand20": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, doc_id) AS crank FROM sims) WHERE crank <= 20""",
    "comps": """SELECT query_id, doc_id, text_score, date, (0.15::DOUBLE * same_label + 0.25::DOUBLE * (shared / (4.0::DOUBLE - shared))) / 0.4::DOUBLE AS category_score FROM cand20""",
    "history": "SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM embeddings) AS doc_id FROM events WHERE event_type = 'purchase'",
    "experts": "SELECT u.user_id, v.vector, v.label, v.grp FROM (SELECT DISTINCT user_id FROM events) u JOIN vecs v ON v.doc_id = u.user_id % (SELECT count(*) FROM embeddings)",
    "histmean": """SELECT user_id, list(x ORDER BY pos) AS vector FROM (SELECT user_id, pos, avg(x) AS x FROM
        (SELECT h.user_id, unnest(v.vector) AS x, unnest(range(len(v.vector))) AS pos FROM history h JOIN vecs v USING (doc_id)) GROUP BY user_id, pos) GROUP BY user_id""",
    "profvec": """SELECT e.user_id, e.label, e.grp, CASE WHEN h.vector IS NULL THEN e.vector ELSE list_transform(list_zip(e.vector, h.vector), lambda p: 0.5::DOUBLE * p[1] + 0.5::DOUBLE * p[2]) END AS vector
        FROM experts e LEFT JOIN histmean h USING (user_id)""",
    "feedback": """SELECT user_id, event_id % (SELECT count(*) FROM documents) AS document_id, (1 + least(4, floor(value / 100)))::INT AS rating, event_id, event_type, ts::DATE AS day, value FROM events""",
    "links": "SELECT DISTINCT l_orderkey AS document_id, l_suppkey AS author_id FROM lineitem",
    "freq": "SELECT total_words AS value, count(*) AS n FROM docs GROUP BY 1",
}


def with_ctes(body: str) -> str:
    """Put the derivations a statement names in front of it, in order."""
    needed: list[str] = []

    def need(sql: str, within: tuple[str, ...] = ()) -> None:
        for name, text in CTES.items():
            if name not in needed and name not in within and re.search(rf"\b{name}\b", sql):
                need(text, (*within, name))
                needed.append(name)

    need(body)
    body = body.strip()
    if not needed:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
