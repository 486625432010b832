"""One registered query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    boilerplate,
    decontaminate,
    language_id,
    lexical_search,
    main_text,
    neighbours,
    ngram_join,
    packing,
    token_counts,
    token_files,
    toxicity,
    url_rules,
    vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text through files of zstandard frames, read back."""
    import public_tokenizers

    return token_files.token_file_digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows."""
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL["op5_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets overlap by 80 % or more."""
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


SQL["op6_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, x) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.x = e.u),
c AS (SELECT doc_id, min(x) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than 3 % of their source's documents (and 5 or more) share."""
    return boilerplate.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


SQL["op2_line_dedup"] = r"""
WITH l AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT k.source, key FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE key <> ''
  GROUP BY k.source, key, pages HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > 0.03::DOUBLE * pages),
m AS (SELECT k.*, bad.key IS NOT NULL AS gone FROM k LEFT JOIN bad ON k.key = bad.key AND k.source IS NOT DISTINCT FROM bad.source),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN kept END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents LEFT JOIN g USING (doc_id)
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of up to 2,048 words in eight buckets of least padding, batches of 65,536 words."""
    return packing.pack(table(spark, sf_dir, "documents"))


SQL["op4_packing"] = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, CASE WHEN length(trim(text, x)) > 0 THEN len(regexp_split_to_array(trim(text, x), '[\t\n\x0B\f\r ]+')) ELSE 0 END AS n
  FROM (SELECT *, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' AS x FROM documents)),
p AS (
  SELECT doc_id, piece, piece * 2048 AS start, least(2048, n - piece * 2048) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil(n / 2048) AS BIGINT)))) AS piece FROM s)),
h AS (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS size, sum(c) OVER (ORDER BY n_tokens) AS total
  FROM (SELECT n_tokens, count(*) AS c FROM p WHERE n_tokens > 0 GROUP BY n_tokens)),
dp(k, j, total, best) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)]
  UNION ALL
  SELECT k + 1, h.j, CAST(h.total AS BIGINT), min(list_concat([CAST(best[1] + h.size * (h.total - dp.total) AS BIGINT), dp.j], best[2:]))
  FROM dp JOIN h ON h.j > dp.j WHERE k < 8 GROUP BY k, h.j, h.total),
o AS (SELECT best, j FROM dp WHERE k = least(8, (SELECT count(*) FROM h)) AND j = (SELECT max(j) FROM h)),
b AS (SELECT size AS bucket FROM h WHERE j IN (SELECT unnest(list_concat([j], best[2:])) FROM o)),
f AS (SELECT p.*, (SELECT min(bucket) FROM b WHERE bucket >= n_tokens) AS bucket FROM p WHERE n_tokens > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece) - 1 AS nth, 65536 // bucket AS room FROM f)
SELECT doc_id, piece, start, n_tokens, bucket, nth // room AS batch, nth % room AS slot FROM r
UNION ALL SELECT doc_id, piece, start, n_tokens, NULL, NULL, NULL FROM p WHERE n_tokens = 0
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match pieces of every document."""
    import public_tokenizers

    pieces = token_counts.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), pieces)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 1 of 3 is held out."""
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(3, 1)
    found = language_id.predict(docs, language_id.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 2 of 4 is held out."""
    held = language_id.held_out(4, 2)
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL. A page is labelled bad if the labels of its id say low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(table(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 8 parts, 16 entries each, six rounds, all in exact integers."""
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


_ROUND = """
a{i} AS MATERIALIZED (
  SELECT vec_id, r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, r, x.part, entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts x JOIN b{i} b ON x.part = b.part) GROUP BY vec_id, r, part)"""
_MEANS = """,
m{i} AS (
  SELECT part, entry, list(m ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT part, entry, pos, sum(c) AS s, count(*) AS n FROM (
        SELECT a.part, a.entry, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM a{i} a JOIN parts x ON a.r = x.r AND a.part = x.part)
      GROUP BY part, entry, pos)) GROUP BY part, entry),
b{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, entry)),"""
SQL["op12_vector_codes"] = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, r, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM kept, range(8) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM parts WHERE r <= 16),""" + "".join(
    (_ROUND + (_MEANS if i < 6 else "")).format(i=i, j=i + 1) for i in range(7)) + """,
coded AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), h
"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring of all documents for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_lexical_search"] = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
g AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM dw),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dw) WHERE t IN (SELECT t FROM iw) GROUP BY r, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t, n_docs),
c AS (
  SELECT r, t, wt.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(dw.w) * n_docs) // l))) AS c
  FROM tf JOIN wt USING (t) JOIN dw USING (r), g),
s AS (SELECT item_id, r, CAST(sum(c * q) AS BIGINT) AS score FROM (SELECT item_id, t, count(*) AS q FROM iw GROUP BY item_id, t) JOIN c USING (t) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN dw USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


# The driver tables put the main text into one article element, with few references in it; so SQL can cut it out.
SQL["op11_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS b FROM pages),
t AS (SELECT *, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS x FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(array_to_string(list_filter(x, lambda y: y <> ''), chr(10) || chr(10)), '&amp;?', '&amp;', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
