"""Text functions, chunking, sentence picks and keywords against plain Python."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import chunking as ck
from docloom.functions import text as tx
from docloom.operators import extractive as ex
from docloom.operators import quality as ql
from docloom.operators.quality import _lcs

WORDS = st.lists(st.sampled_from(["aa", "bb", "cc", "dd.", "ee.", "ff!"]), max_size=60).map(" ".join)


def values(spark, texts, col, cast="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, t {cast}").repartition(1)
    return [r[1] for r in sorted(df.select("i", col.alias("v")).collect())]


def python_pack(pieces, limit, low=0):
    out, cur, n = [], [], 0
    for p in pieces:
        w = len(p.split())
        if cur and n + w > limit and n >= low:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += w
    return out + ([" ".join(cur)] if cur else [])


def python_sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def python_pick(sents, target):
    """sents: (score, words); the budgeted pick in plain steps."""
    low, high = int(target * 0.9), int(target * 1.1)
    order = sorted(range(len(sents)), key=lambda i: (-sents[i][0], i))
    got, n, full = [], 0, False
    for i in order:
        if n + sents[i][1] <= high:
            got.append(i)
            n += sents[i][1]
            if n >= low:
                full = True
                break
    if full and target - n > 0.1 * target:
        for i in order:
            if i not in got and n + sents[i][1] <= high:
                got.append(i)
                break
    return sorted(got)


def test_word_count_edges(spark):
    assert values(spark, ["", None, "  a  b\n c ", "x"], tx.word_count(F.col("t"))) == [0, 0, 3, 1]


def test_tier_edges(spark):
    assert values(spark, [0, 600, 601, 2500, 2501, 20000, 20001], tx.tier(F.col("t")), "int") == [1, 1, 2, 2, 3, 3, 4]


def test_keyword_budget(spark):
    assert values(spark, [0, 10, 1000, 10**6], tx.keyword_budget(F.col("t")), "int") == [2, 2, 12, 15]


def test_clean_legal_text(spark):
    raw = ["See https://x.example/a_b?c=1 now\x07 \t and\n\n\n  www.y.example/z end", "12.5 (3)", None]
    assert values(spark, raw, tx.clean_legal_text(F.col("t"))) == ["See now and\nend", "", ""]


def test_term_counts_is_a_counter(spark):
    texts = ["b a b c a b", "", "one", "z z z z"]
    got = values(spark, texts, tx.term_counts(tx.words(F.col("t"))))
    assert [{r.term: r.tf for r in g} for g in got] == [dict(Counter(t.split())) for t in texts]


@settings(max_examples=1, deadline=None)
@given(st.lists(WORDS, min_size=40, max_size=40))
def test_packing_equals_plain_greedy(spark, texts):
    for limit, low in ((7, 0), (9, 4), (3, 0)):
        got = values(spark, texts, ck.pack(tx.sentences(F.col("t")), " ", limit, low))
        assert got == [python_pack(python_sentences(t), limit, low) for t in texts]


@settings(max_examples=1, deadline=None)
@given(st.lists(WORDS, min_size=40, max_size=40))
def test_chunks_keep_every_word_within_the_limit(spark, texts):
    got = values(spark, texts, ck.chunk(F.col("t"), 8))
    for t, chunks in zip(texts, got):
        assert " ".join(chunks).split() == t.split()
        assert all(0 < len(c.split()) <= 8 for c in chunks)


def test_chunk_keeps_headers(spark):
    text = "intro words here\nArticle 1: first part of text\nArticle 2: second part of it"
    (got,) = values(spark, [text], ck.chunk(F.col("t"), 7))
    assert got == ["intro words here", "Article 1: first part of text", "Article 2: second part of it"]


def test_long_sections_keep_their_own_mark(spark):
    text = "a b c\nArticle 1\nd e f\nArticle 2\ng h i"
    (got,) = values(spark, [text], ck.long_sections(F.col("t"), 4))
    assert [g.split("\n")[0] for g in got] == ["a b c", "Article 1", "Article 2"]


def test_middle_weights_sum_to_n(spark):
    for n, w in enumerate(values(spark, [1, 2, 3, 7], ck.middle_weights(F.col("t")), "int")):
        size = [1, 2, 3, 7][n]
        assert len(w) == size and abs(sum(w) - size) < 1e-9
        assert w == sorted(w[: (size + 1) // 2]) + w[(size + 1) // 2:]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), min_size=1, max_size=12), st.integers(0, 40)), min_size=60, max_size=60))
def test_pick_equals_plain_steps(spark, cases):
    rows = [(n, [(-float(s), i, w, f"s{i}") for i, (s, w) in enumerate(sents)], target) for n, (sents, target) in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, s array<struct<neg:double,i:int,words:int,t:string>>, target int")
    got = {r.n: r.p for r in df.select("n", ex.pick(F.col("s"), F.col("target")).alias("p")).collect()}
    for n, (sents, target) in enumerate(cases):
        assert got[n] == " ".join(f"s{i}" for i in python_pick(sents, target)), (sents, target)


def test_extracts_stay_within_budget_and_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    out = ex.extract(docs, "content", F.lit(60), ex.corpus_idf(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert len(r.extract.split()) <= 66
        at = [r.content.find(s) for s in python_sentences(r.extract)]
        assert all(a >= 0 for a in at)


def test_every_document_gets_a_summary(spark, data):
    from docloom.plans.summaries import summarise

    base = spark.read.parquet(f"{data}/documents.parquet")
    docs = base.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), tx.word_count(F.col("text")).alias("total_words"), F.lit(None).cast("string").alias("summary"))
    whole = F.repeat(F.concat(F.col("content"), F.lit("\n\n")), 400)
    longest = docs.orderBy(F.col("total_words").desc()).limit(1).select((F.col("document_id") + 10**6).alias("document_id"), whole.alias("content"), (F.col("total_words") * 400).alias("total_words"), "summary")
    empty = spark.createDataFrame([(2 * 10**6, "", 0, None)], docs.schema)
    docs = docs.unionByName(longest).unionByName(empty)
    secs = docs.select("document_id", F.lit(0).alias("section_order"), "content")
    made = summarise(docs, secs, ex.corpus_idf(docs)).collect()
    assert len(made) == docs.count()
    assert {r.tier for r in made} >= {1, 4}
    assert all(r.compression_ratio <= 0.4 for r in made if r.tier > 1)


def test_user_summariser_runs_on_the_extract(spark, data):
    import pandas as pd

    from docloom.plans.summaries import summarise

    @F.pandas_udf("string")
    def first_word(s: pd.Series) -> pd.Series:
        return s.str.split().str[0].fillna("")

    base = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    docs = base.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), tx.word_count(F.col("text")).alias("total_words"), F.lit(None).cast("string").alias("summary"))
    made = summarise(docs, docs.select("document_id", F.lit(0).alias("section_order"), "content"), ex.corpus_idf(docs), first_word).collect()
    assert len(made) == 20 and all(r.summary_word_count <= 1 for r in made)


def test_diverse_keywords_respect_the_budget(spark, data):
    from docloom.operators.keywords import extract_keywords

    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    n = {r.document_id: r.n for r in docs.select("document_id", tx.keyword_budget(tx.word_count(F.col("content"))).alias("n")).collect()}
    rows = extract_keywords(docs, ex.corpus_idf(docs)).collect()
    seen = Counter((r.document_id, r.keyword) for r in rows)
    assert max(seen.values()) == 1
    per_doc = Counter(r.document_id for r in rows)
    assert all(c <= n[d] for d, c in per_doc.items())


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs_by_bits(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert _lcs(a, b) == t[-1][-1]


def test_rouge_identity(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "x y", "a b"), (3, "", "a")], "document_id int, s string, t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("document_id", ql.rouge_n(F.col("s"), F.col("t"), 1), ql.rouge_n(F.col("s"), F.col("t"), 2)).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert {r.document_id: r.rouge_l for r in ql.rouge_l(df, "s", "t").collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
