"""Chunks, extracts, summaries, keywords, quality."""

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import chunking as ck
from docloom.functions import text as tx
from docloom.operators import extractive as ex
from docloom.operators import keywords as kw
from docloom.operators import quality as ql
from docloom.plans import summaries as sm
from docloom.session import spread

from .base import Tables, query, tokens_sql, words_sql

SENT_SQL = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \t\r\n')), lambda s: s <> '')"""


def positions(df, chunks, *carry):
    rows = df.select("document_id", *carry, F.posexplode(chunks).alias("pos", "chunk"))
    return rows.withColumn("words", tx.word_count(F.col("chunk"))).withColumn("chunk_md5", F.md5("chunk")).drop("chunk")


@query("sentences", "TXT1", f"""SELECT document_id, (i - 1)::INT AS pos, md5(s[i]) AS sentence_md5 FROM (SELECT document_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT document_id, {SENT_SQL.format('content')} AS s FROM docs))""")
def sentences(t: Tables):
    return t.docs.select("document_id", F.posexplode(tx.sentences(F.col("content"))).alias("pos", "s")).select("document_id", "pos", F.md5("s").alias("sentence_md5"))


_HASH = "('0x' || substr(md5(tok), 1, 7))::BIGINT % 262144"


@query("sentence_scores", "TXT2", f"""WITH d AS (SELECT {_HASH} AS b, count(DISTINCT document_id) AS df FROM (SELECT document_id, unnest(toks) AS tok FROM toks) GROUP BY 1),
    s AS (SELECT document_id, i - 1 AS pos, s[i] AS sent FROM (SELECT document_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT document_id, {SENT_SQL.format('content')} AS s FROM docs))),
    k AS (SELECT document_id, pos, {_HASH} AS kb, count(*) AS tf FROM (SELECT document_id, pos, unnest({tokens_sql('sent')}) AS tok FROM s) GROUP BY ALL),
    w AS (SELECT document_id, pos, sum((tf * ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (df + 1))) ** 2) AS w FROM k JOIN d ON d.b = kb GROUP BY 1, 2)
    SELECT s.document_id, s.pos::INT AS pos, round(sqrt(coalesce(w, 0)), 6) AS score FROM s LEFT JOIN w ON w.document_id = s.document_id AND w.pos = s.pos""")
def sentence_scores(t: Tables):
    idf = ex.corpus_idf(t.texts, hash_name="md5")
    scored = ex.scored_sentences(F.col("content"), F.col("_idf"), hash_name="md5")
    rows = ex.with_idf(t.texts.select("document_id", "content"), idf).select("document_id", F.explode(scored).alias("s"))
    return rows.select("document_id", F.col("s.i").alias("pos"), (-F.col("s.neg")).alias("score"))


# The budgeted pick as list folds: state and items share one shape (words so far, positions picked, closed or not).
_PICK_SQL = f"""WITH d AS (SELECT {_HASH} AS b, count(DISTINCT document_id) AS df FROM (SELECT document_id, unnest(toks) AS tok FROM toks) GROUP BY 1),
    sl AS (SELECT document_id, content, {SENT_SQL.format('content')} AS s, greatest(floor(total_words * 0.3::DOUBLE), 5)::INT AS target FROM docs),
    s AS (SELECT document_id, i - 1 AS pos, s[i] AS sent FROM (SELECT document_id, s, unnest(range(1, len(s) + 1)) AS i FROM sl)),
    k AS (SELECT document_id, pos, {_HASH} AS kb, count(*) AS tf FROM (SELECT document_id, pos, unnest({tokens_sql('sent')}) AS tok FROM s) GROUP BY ALL),
    w AS (SELECT document_id, pos, sum((tf * ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (df + 1))) ** 2) AS w FROM k JOIN d ON d.b = kb GROUP BY 1, 2),
    l AS (SELECT s.document_id, list({{'n': {words_sql('sent')}::INT, 'got': [s.pos::INT], 'full': false}} ORDER BY round(sqrt(coalesce(w, 0)), 6) DESC, s.pos) AS l FROM s LEFT JOIN w ON w.document_id = s.document_id AND w.pos = s.pos GROUP BY 1),
    b AS (SELECT sl.*, l, floor(target * 0.9::DOUBLE)::INT AS low, floor(target * 1.1::DOUBLE)::INT AS high FROM sl JOIN l USING (document_id)),
    r1 AS (SELECT *, list_reduce(list_prepend({{'n': 0::INT, 'got': []::INT[], 'full': false}}, l), lambda a, x: CASE WHEN NOT a.full AND a.n + x.n <= high THEN {{'n': a.n + x.n, 'got': list_concat(a.got, x.got), 'full': a.n + x.n >= low}} ELSE a END) AS r FROM b),
    r2 AS (SELECT *, CASE WHEN r.full AND target - r.n > target * 0.1::DOUBLE THEN list_reduce(list_prepend({{'n': r.n, 'got': r.got, 'full': false}}, l), lambda a, x: CASE WHEN NOT a.full AND NOT list_contains(a.got, x.got[1]) AND a.n + x.n <= high
      THEN {{'n': a.n + x.n, 'got': list_concat(a.got, x.got), 'full': true}} ELSE a END).got ELSE r.got END AS got FROM r1),
    e AS (SELECT document_id, array_to_string(list_filter(s, lambda v, i: list_contains(got, (i - 1)::INT)), ' ') AS extract FROM r2 UNION ALL SELECT document_id, content FROM sl WHERE len(s) = 0)
    SELECT document_id, {words_sql('extract')}::INT AS words, md5(extract) AS extract_md5 FROM e"""


@query("picked_sentences", "TXT3", _PICK_SQL)
def picked_sentences(t: Tables):
    target = F.greatest(F.floor(F.col("total_words") * 0.3), F.lit(5)).cast("int")
    out = ex.extract(t.texts.select("document_id", "content", "total_words"), "content", target, ex.corpus_idf(t.texts, hash_name="md5"), hash_name="md5")
    return out.select("document_id", tx.word_count(F.col("extract")).alias("words"), F.md5("extract").alias("extract_md5"))


@query("structure_chunks", "TXT4")
def structure_chunks(t: Tables):
    return positions(t.texts, ck.chunk(F.col("content")))


@query("chunk_sizes", "TXT5", "SELECT document_id, CASE WHEN n <= 100 THEN n ELSE greatest(100, least(n // greatest(1, n // 400), 400)) END::INT AS size FROM (SELECT document_id, total_words AS n FROM docs)")
def chunk_sizes(t: Tables):
    return t.docs.select("document_id", tx.balanced_chunk_size(F.col("total_words")).alias("size"))


# Greedy packing as a list fold: state is the list of (words, text) chunks.
_PACK_SQL = f"""WITH s AS (SELECT document_id, list_transform({SENT_SQL.format('content')}, lambda x: [{{'n': {words_sql('x')}, 't': x}}]) AS s FROM docs),
    p AS (SELECT document_id, list_reduce(s, lambda a, x: CASE WHEN a[-1].n + x[1].n <= 120 THEN list_concat(a[:-2], [{{'n': a[-1].n + x[1].n, 't': a[-1].t || ' ' || x[1].t}}]) ELSE list_concat(a, x) END) AS p FROM s WHERE len(s) > 0)
    SELECT document_id, (i - 1)::INT AS pos, p[i].n::INT AS words, md5(p[i].t) AS chunk_md5 FROM (SELECT document_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)"""


@query("sentence_chunks", "TXT6", _PACK_SQL)
def sentence_chunks(t: Tables):
    return positions(t.texts, ck.sentence_chunks(F.col("content"), 120))


@query("subsections", "TXT7", _PACK_SQL.replace("a[-1].n + x[1].n <= 120", "a[-1].n + x[1].n <= 90 OR a[-1].n < 40").replace(
    f"SELECT document_id, list_transform(", f"SELECT document_id, CASE WHEN total_words <= 90 THEN [[{{'n': total_words, 't': content}}]] ELSE list_transform(").replace("}]) AS s FROM docs", "}]) END AS s FROM docs"))
def subsections(t: Tables):
    return positions(t.texts, ck.subsections(F.col("content"), 40, 90))


@query("long_sections", "TXT8", r"""WITH p AS (SELECT document_id, CASE WHEN total_words > 200 THEN list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda s: trim(s, E' \t\r\n')), lambda s: s <> '') ELSE [content] END AS p FROM
      (SELECT document_id, total_words, replace(content, chr(10), chr(10) || chr(10)) AS content FROM docs))
    SELECT document_id, (i - 1)::INT AS pos, """ + words_sql("p[i]") + r"""::INT AS words, md5(p[i]) AS chunk_md5 FROM (SELECT document_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)""")
def long_sections(t: Tables):
    """Lines stand as double-spaced paragraphs here, so that the last mark of the cascade applies."""
    doubled = t.docs.select("document_id", F.regexp_replace("content", "\n", "\n\n").alias("content"))
    return positions(doubled, ck.long_sections(F.col("content"), 200))


@query("third_tier_chunk_weights", "TXT9 WIN6")
def third_tier_chunk_weights(t: Tables):
    rows = ex.third_tier_chunks(joined_sections(t))
    return rows.select("document_id", "section_order", "pos", "words", F.round("weight", 6).alias("weight"), F.md5("chunk").alias("chunk_md5"))


def joined_sections(t: Tables):
    """One section per document: long enough for every branch of the section rule."""
    return t.texts.select("document_id", F.lit(0).alias("section_order"), "content")


@query("position_weights", "WIN6", """SELECT document_id, section_order, round(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE w * n / sum(w) OVER (PARTITION BY document_id) END, 6) AS weight FROM
    (SELECT document_id, section_order, n, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE - pow(-1 + 2.0::DOUBLE * section_order / (n - 1), 2) END AS w FROM (SELECT document_id, section_order, count(*) OVER (PARTITION BY document_id) AS n FROM secs))""")
def position_weights(t: Tables):
    n = F.size(F.split("content", "\n"))
    return t.docs.select("document_id", F.posexplode(ck.middle_weights(n)).alias("section_order", "weight")).withColumn("weight", F.round("weight", 6))


@query("document_position_weights", "WIN7", "SELECT document_id, section_order, CASE section_order WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.5 END::DOUBLE AS weight FROM secs")
def document_position_weights(t: Tables):
    return t.secs.select("document_id", "section_order", ck.position_weight(F.col("section_order")).alias("weight"))


@query("chunk_shares", "WIN8", "SELECT document_id, section_order, CASE section_order WHEN 0 THEN 0.34 WHEN 1 THEN 0.30 WHEN 2 THEN 0.245 WHEN 3 THEN 0.20 WHEN 4 THEN 0.165 ELSE 0.125 END::DOUBLE AS share FROM secs")
def chunk_shares(t: Tables):
    return t.secs.select("document_id", "section_order", ck.chunk_share(F.col("section_order")).alias("share"))


@query("weighted_shares", "TXT10", """SELECT document_id, section_order, round(greatest(0.15::DOUBLE, least(0.35::DOUBLE, CASE WHEN tot > 0 THEN 100.0::DOUBLE / tot ELSE 0.5 END
    * CASE section_order WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.5 END::DOUBLE)), 6) AS share FROM (SELECT *, sum(word_count) OVER (PARTITION BY document_id) AS tot FROM secs)""")
def weighted_shares(t: Tables):
    from pyspark.sql import Window

    total = F.sum("word_count").over(Window.partitionBy("document_id"))
    share = ex.weighted_share(total, ck.position_weight(F.col("section_order")), 100)
    return t.secs.select("document_id", "section_order", F.round(share, 6).alias("share"))


def _extracts(df):
    return df.select("document_id", tx.word_count(F.col("extract")).alias("words"), F.md5("extract").alias("extract_md5"))


@query("second_tier_sources", "TXT11", """SELECT document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY section_order)) AS text_md5 FROM secs GROUP BY 1""")
def second_tier_sources(t: Tables):
    """What the second tier reads: the lines of a document as sections, as one text."""
    docs = sm.section_text(t.texts.select("document_id", "content"), t.secs.select("document_id", "section_order", "content"))
    return docs.select("document_id", F.md5("content").alias("text_md5"))


@query("second_tier_extracts", "TXT11")
def second_tier_extracts(t: Tables):
    return _extracts(ex.second_tier(t.texts, ex.corpus_idf(t.texts)))


@query("third_tier_extracts", "TXT12")
def third_tier_extracts(t: Tables):
    return _extracts(ex.third_tier(joined_sections(t), ex.corpus_idf(t.texts)))


@query("fourth_tier_extracts", "TXT13")
def fourth_tier_extracts(t: Tables):
    return _extracts(ex.fourth_tier(t.texts, ex.corpus_idf(t.texts)))


@query("shrunk_extracts", "TXT14")
def shrunk_extracts(t: Tables):
    return _extracts(ex.fixed_share(t.texts, ex.corpus_idf(t.texts), 60))


@query("summaries_by_tier", "TXT15")
def summaries_by_tier(t: Tables):
    docs = t.texts.withColumn("summary", F.lit(None).cast("string"))
    made = sm.summarise(docs, joined_sections(t), ex.corpus_idf(t.texts))
    return made.select("document_id", "tier", "summary_word_count", "compression_ratio", F.md5("summary").alias("summary_md5"))


def load_marker():
    """A stand-in for a neural summariser: marks what it was given."""
    return lambda texts: [f"> {x}" for x in texts]


@query("rewritten_by_tier", "UDF2", """SELECT document_id, CASE WHEN total_words <= 600 THEN 1 WHEN total_words <= 2500 THEN 2 WHEN total_words <= 20000 THEN 3 ELSE 4 END AS tier,
    true AS marked, CASE WHEN total_words <= 600 THEN md5('> ' || content) END AS short_md5 FROM docs""")
def rewritten_by_tier(t: Tables):
    """Every extract goes through a user's summariser, loaded in the workers; short texts go whole."""
    from docloom.operators.batches import summariser_udf

    docs = t.texts.withColumn("summary", F.lit(None).cast("string"))
    made = sm.summarise(docs, joined_sections(t), ex.corpus_idf(t.texts), summariser_udf(load_marker))
    return made.select("document_id", "tier", F.col("summary").startswith("> ").alias("marked"), F.when(F.col("tier") == 1, F.md5("summary")).alias("short_md5"))


def count_batch(rows: pa.Table) -> pa.Table:
    """A user's function over a batch: words of each text, and how many rows it came with."""
    words = [len((x or "").split()) for x in rows["content"].to_pylist()]
    return pa.table({"document_id": rows["document_id"], "lang": rows["lang"], "words": pa.array(words, pa.int64()), "together": pa.array([len(rows)] * len(rows), pa.int32())})


@query("batched_counts", "UDF3", f"""SELECT document_id, lang, words, least(50, n - (rn - 1) // 50 * 50)::INT AS together FROM (SELECT document_id, lang, {words_sql('content')}::BIGINT AS words,
    count(*) OVER (PARTITION BY lang, document_id % 8) AS n, row_number() OVER (PARTITION BY lang, document_id % 8 ORDER BY document_id) AS rn FROM docs)""")
def batched_counts(t: Tables):
    """A user's function over batches of 50 documents of one language, dealt out over eight shares of a language."""
    from docloom.operators.batches import process_in_batches

    docs = t.docs.select("document_id", "lang", "content", F.pmod("document_id", F.lit(8)).alias("share"))
    return process_in_batches(docs, count_batch, 50, "document_id long, lang string, words long, together int", ["lang", "share"], ["document_id"])


@query("first_word_summaries", "TXT16", r"SELECT document_id, array_to_string(regexp_extract_all(content, '\S+')[1:50], ' ') AS summary FROM docs")
def first_word_summaries(t: Tables):
    return t.docs.select("document_id", tx.first_words(F.col("content"), 50).alias("summary"))


_KW_SQL = f"""WITH tk AS (SELECT document_id, {tokens_sql('content', 2)} AS t FROM docs), df AS (SELECT {_HASH} AS b, count(DISTINCT document_id) AS df FROM (SELECT document_id, unnest(toks) AS tok FROM toks) GROUP BY 1),
    u AS (SELECT document_id, tok, tf, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (df + 1)) AS idf FROM (SELECT document_id, tok, count(*) AS tf FROM (SELECT document_id, unnest(t) AS tok FROM tk) GROUP BY ALL) JOIN df ON b = {_HASH}),
    l AS (SELECT document_id, sqrt(sum((tf * idf) ** 2)) AS len FROM u GROUP BY 1),
    bi AS (SELECT DISTINCT document_id, t[i] AS a, t[i + 1] AS c FROM (SELECT document_id, t, unnest(range(1, len(t))) AS i FROM tk)),
    cand AS (SELECT document_id, tok AS keyword, round(tf * idf / len, 6) AS score FROM u JOIN l USING (document_id) WHERE len > 0
      UNION ALL SELECT bi.document_id, bi.a || ' ' || bi.c, round((x.idf * x.tf * x.idf + y.idf * y.tf * y.idf) / (sqrt(x.idf ** 2 + y.idf ** 2) * len), 6)
      FROM bi JOIN u x ON x.document_id = bi.document_id AND x.tok = bi.a JOIN u y ON y.document_id = bi.document_id AND y.tok = bi.c JOIN l ON l.document_id = bi.document_id WHERE len > 0 AND x.idf + y.idf > 0)
    SELECT document_id, keyword, score FROM (SELECT c.*, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, keyword) AS rn, trunc(greatest(2.0, least(15.0, 2.5::DOUBLE * ln(greatest(total_words, 1)) - 4.77::DOUBLE))) AS k
      FROM cand c JOIN (SELECT document_id, total_words FROM docs) d USING (document_id)) WHERE rn <= k"""


@query("extracted_keywords", "TXT17", _KW_SQL)
def extracted_keywords(t: Tables):
    return kw.extract_keywords(t.texts, ex.corpus_idf(t.texts, hash_name="md5"), diversity=None, hash_name="md5")


# Rounds take the best candidate that shares no word with those taken; documents that run out of such candidates get the
# diversity rule in full, as a fold over their few candidates.
_LIKE_SQL = "(len(list_intersect(x.w, g.w)) / sqrt(len(x.w) * len(g.w)))"
_DIVERSE_SQL = "WITH RECURSIVE " + _KW_SQL[5:_KW_SQL.index("SELECT document_id, keyword, score FROM (SELECT c.*")].rstrip() + f""",
    cw AS MATERIALIZED (SELECT document_id, {{'n': -score, 't': keyword, 's': score, 'w': string_split(keyword, ' ')}} AS x, trunc(greatest(2.0, least(15.0, 2.5::DOUBLE * ln(greatest(total_words, 1)) - 4.77::DOUBLE)))::INT AS k
      FROM cand JOIN (SELECT document_id, total_words FROM docs) d USING (document_id)),
    walk(document_id, k, got) AS (SELECT document_id, any_value(k), [min(x)] FROM cw GROUP BY document_id
      UNION ALL SELECT w.document_id, any_value(w.k), list_append(any_value(w.got), min(x)) FROM walk w JOIN cw ON cw.document_id = w.document_id
        WHERE len(w.got) < w.k AND NOT list_has_any(flatten(list_transform(w.got, lambda g: g.w)), x.w) GROUP BY w.document_id),
    near AS MATERIALIZED (SELECT document_id, arg_max(got, len(got)) AS got, any_value(k) AS k FROM walk GROUP BY document_id),
    few AS (SELECT document_id, any_value(near.k) AS k, list(x ORDER BY x) AS c FROM near JOIN cw USING (document_id) GROUP BY document_id HAVING any_value(len(got)) < least(any_value(near.k), count(*))),
    picked AS (SELECT document_id, got FROM near WHERE document_id NOT IN (SELECT document_id FROM few)
      UNION ALL SELECT document_id, list_reduce(list_transform(range(0, k), lambda i: [c[1]]), lambda a, y: list_concat(a, list_transform(list_sort(list_transform(list_filter(c, lambda x: NOT list_contains(list_transform(a, lambda g: g.t), x.t)),
        lambda x: {{'o': -round(0.3::DOUBLE * x.s - 0.7::DOUBLE * list_max(list_transform(a, lambda g: {_LIKE_SQL})), 9), 'x': x}}))[:1], lambda z: z.x))) AS got FROM few)
    SELECT document_id, g.t AS keyword, g.s AS score FROM (SELECT document_id, unnest(got) AS g FROM picked)"""


@query("diverse_keywords", "TXT17", _DIVERSE_SQL)
def diverse_keywords(t: Tables):
    return kw.extract_keywords(t.texts, ex.corpus_idf(t.texts, hash_name="md5"), hash_name="md5")


@query("keyword_batch", "TXT18", f"""SELECT document_id, keyword, score FROM kws WHERE score >= 0.2
    UNION ALL SELECT m.* FROM ({_DIVERSE_SQL}) m JOIN summarised s USING (document_id) WHERE s.summary IS NOT NULL AND document_id NOT IN (SELECT document_id FROM kws WHERE score >= 0.2)""")
def keyword_batch(t: Tables):
    return sm.add_keywords(spread(t.summarised), t.kws.filter("score >= 0.2"), ex.corpus_idf(t.texts, hash_name="md5"), hash_name="md5").select("document_id", "keyword", "score")


@query("replaced_summaries", "TXT19", rf"""SELECT document_id, CASE WHEN quality IS NOT NULL THEN {words_sql('title')} END::INT AS summary_word_count, CASE WHEN quality IS NOT NULL THEN round(coalesce({words_sql('title')}::DOUBLE / nullif(total_words, 0), 0), 6) END AS compression_ratio
    FROM summarised LEFT JOIN (SELECT doc_id AS document_id, quality FROM labels) l USING (document_id)""")
def replaced_summaries(t: Tables):
    docs = t.summarised.withColumns({"summary_word_count": F.lit(None).cast("int"), "compression_ratio": F.lit(None).cast("double")})
    new = t.docs.join(t.raw("labels").select(F.col("doc_id").alias("document_id")), "document_id").select("document_id", F.col("title").alias("summary"))
    return sm.replace_summaries(docs, new).select("document_id", "summary_word_count", "compression_ratio")


@query("rouge_scores", "TXT20", r"""WITH w AS (SELECT document_id, regexp_extract_all(summary, '\S+') AS a, regexp_extract_all(content, '\S+') AS b FROM summarised WHERE summary IS NOT NULL),
    g AS (SELECT document_id, list_distinct(a) AS a1, list_distinct(b) AS b1, list_distinct(list_transform(list_zip(a[1:-2], a[2:]), lambda p: p[1] || ' ' || p[2])) AS a2, list_distinct(list_transform(list_zip(b[1:-2], b[2:]), lambda p: p[1] || ' ' || p[2])) AS b2 FROM w)
    SELECT document_id, round(coalesce(2.0::DOUBLE * len(list_intersect(a1, b1)) / nullif(len(a1) + len(b1), 0), 0), 6) AS rouge_1, round(coalesce(2.0::DOUBLE * len(list_intersect(a2, b2)) / nullif(len(a2) + len(b2), 0), 0), 6) AS rouge_2 FROM g""")
def rouge_scores(t: Tables):
    s, c = F.col("summary"), F.col("content")
    return t.summarised.filter(s.isNotNull()).select("document_id", ql.rouge_n(s, c, 1).alias("rouge_1"), ql.rouge_n(s, c, 2).alias("rouge_2"))


# Rows of the usual table of common subsequences, each a list: for a word w and the row p above, cell j is p[j-1] + 1 where
# the word is the other text's j-th, else the larger of the cell above and the cell before.
@query("rouge_l_scores", "TXT20", r"""WITH RECURSIVE w AS (SELECT document_id, regexp_extract_all(content, '\S+')[1:12] AS a, list_reverse(regexp_extract_all(content, '\S+')[4:24]) AS b FROM docs),
    r(document_id, i, a, b, p) AS (SELECT document_id, 0, a, b, list_transform(b, lambda x: 0) FROM w UNION ALL
      SELECT document_id, i + 1, a, b, list_reduce(list_prepend({'j': 0, 'got': []::INT[]}, list_transform(b, lambda x, j: {'j': j::INT, 'got': [CASE WHEN x = a[i + 1] THEN 1 + CASE WHEN j > 1 THEN p[j - 1] ELSE 0 END ELSE p[j] END]})),
        lambda s, x: {'j': x.j, 'got': list_append(s.got, greatest(x.got[1], coalesce(s.got[len(s.got)], 0)))}).got FROM r WHERE i < len(a) AND len(b) > 0)
    SELECT document_id, round(CASE WHEN len(b) > 0 THEN 2.0::DOUBLE * p[len(b)] / (len(a) + len(b)) ELSE 0 END, 6) AS rouge_l FROM r WHERE i = len(a) OR len(b) = 0""")
def rouge_l_scores(t: Tables):
    """The first twelve words of a document against its words 4 to 24 in reverse order."""
    words = tx.words(F.col("content"))
    pairs = t.texts.select("document_id", F.array_join(F.slice(words, 1, 12), " ").alias("a"), F.array_join(F.reverse(F.slice(words, 4, 21)), " ").alias("b"))
    return ql.rouge_l(pairs, "a", "b")


@query("keyword_retention", "TXT21", f"""SELECT document_id, round(coalesce(len(list_intersect(k, s))::DOUBLE / nullif(len(k), 0), 0), 6) AS retention FROM (SELECT document_id, list_distinct({tokens_sql('title')}) AS k, list_distinct({tokens_sql('summary')}) AS s FROM summarised WHERE summary IS NOT NULL)""")
def keyword_retention(t: Tables):
    rows = t.summarised.filter(F.col("summary").isNotNull())
    return rows.select("document_id", ql.keyword_retention(F.col("summary"), tx.keyword_words(F.col("title"))).alias("retention"))


def quality(t: Tables):
    rows = t.summarised.filter(F.col("summary").isNotNull()).withColumns({"tier": tx.tier(F.col("total_words")), "keywords": F.col("title")})
    return ql.quality_table(rows)


@query("summary_quality_by_tier", "TXT23", f"""WITH q AS (SELECT document_id, CASE WHEN total_words <= 600 THEN 1 WHEN total_words <= 2500 THEN 2 WHEN total_words <= 20000 THEN 3 ELSE 4 END AS tier, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c,
      trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS s, list_distinct({tokens_sql("replace(title, ',', ' ')")}) AS k, list_distinct({tokens_sql('summary')}) AS st FROM summarised WHERE summary IS NOT NULL)
    SELECT tier, count(*) AS documents, round(avg(coalesce(round(length(s)::DOUBLE / nullif(length(c), 0), 6), 0)), 6) AS compression_ratio, round(avg(coalesce(round(len(list_intersect(k, st))::DOUBLE / nullif(len(k), 0), 6), 0)), 6) AS keyword_retention,
    round(avg(length(c)), 6) AS original_length, round(avg(length(s)), 6) AS summary_length, round(avg(len(k)), 6) AS keyword_count FROM q GROUP BY 1""")
def summary_quality_by_tier(t: Tables):
    return ql.tier_means(quality(t)).drop("rouge_1", "rouge_2")
