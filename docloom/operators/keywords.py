"""Keywords of a document: uni- and bigrams by likeness to the document, with a diversity step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import let
from . import features as ft
from .extractive import with_idf

DIVERSITY = 0.7


def _weighted_tokens(toks: Column, counted: Column) -> Column:
    """Tokens in text order as struct<i,idf,w,term>.

    ``counted`` lists the distinct terms in order. Positions sorted by term line up with every count repeated tf
    times; sorting by position brings them back into text order. n log n, inside the row.
    """
    by_term = F.sort_array(F.transform(toks, lambda t, i: F.struct(t.alias("term"), i.alias("i"))))
    repeated = F.flatten(F.transform(counted, lambda c: F.array_repeat(c, c["tf"])))
    return F.sort_array(F.zip_with(by_term, repeated, lambda x, c: F.struct(
        x["i"].alias("i"), c["idf"].alias("idf"), c["w"].alias("w"), c["term"].alias("term"))))


def candidates(docs: DataFrame, idf: Column, text: str = "content", buckets: int = ft.BUCKETS,
               hash_name: str = "xxhash64") -> DataFrame:
    """Documents with ``_cand``: distinct uni- and bigrams as struct<neg,term>, best first.

    The score is the cosine between the candidate's tf-idf vector and the document's.
    """
    held = docs.withColumn("_t", tx.tokens(F.col(text), min_len=2))
    price = lambda idf_, c: F.element_at(idf_, ft.bucket(c["term"], buckets, hash_name) + 1)
    counted = with_idf(held.withColumn("_c", tx.term_counts(F.col("_t"))), idf).withColumn(
        "_v", F.transform("_c", lambda c: price(F.col("_idf"), c))).drop("_idf")
    held = counted.withColumn("_uni", F.zip_with("_c", "_v", lambda c, v: F.struct(
        c["term"].alias("term"), c["tf"].alias("tf"), v.alias("idf"), (c["tf"] * v).alias("w"))))
    held = held.withColumn("_tok", _weighted_tokens(F.col("_t"), F.col("_uni")))
    held = held.withColumn("_len", F.sqrt(F.aggregate("_uni", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))
    uni = F.transform("_uni", lambda x: F.struct((-F.round(F.try_divide(x["w"], F.col("_len")), 6)).alias("neg"), x["term"].alias("term")))
    n = F.size("_tok")
    top = lambda a, b: a["idf"] * a["w"] + b["idf"] * b["w"]
    size = lambda a, b: F.sqrt(a["idf"] * a["idf"] + b["idf"] * b["idf"]) * F.col("_len")
    bi = F.when(n > 1, F.zip_with(
        F.slice("_tok", 1, F.greatest(n - 1, F.lit(0))), F.slice("_tok", 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct((-F.round(F.try_divide(top(a, b), size(a, b)), 6)).alias("neg"), F.concat_ws(" ", a["term"], b["term"]).alias("term")),
    )).otherwise(F.array().cast("array<struct<neg:double,term:string>>"))
    ordered = let(F.sort_array(F.concat(uni, bi)), lambda o: F.filter(
        F.zip_with(o, F.slice(F.concat(F.array(F.lit(None).cast("struct<neg:double,term:string>")), o), 1, F.size(o)),
                   lambda a, b: F.when(~a["term"].eqNullSafe(b["term"]), a)), lambda x: x["neg"].isNotNull()))
    return held.withColumn("_cand", ordered).drop("_t", "_c", "_v", "_tok", "_uni", "_len")


def _likeness(a: Column, b: Column) -> Column:
    """Shared words of two candidates over the root of their word counts' product (cosine of 0/1 word vectors)."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.sqrt((F.size(x) * F.size(y)).cast("double"))


def diversify(pool: Column, k: Column, diversity: float = DIVERSITY) -> Column:
    """Pick k of all candidates one by one: (1 - d) * score - d * likeness to what is picked already.

    Candidates have one or two words, so any that shares a word with a picked one has a likeness of 0.5 at least. Above
    d = 2/3 it is then worth less than nothing, and one that shares none is worth 0 or more: the rule comes down to one
    walk through the candidates, best first, taking those that share no word. Only rows that run out of such
    candidates before they have k (or a smaller d) need the rule in full.
    """

    def step(got: Column, _: Column) -> Column:
        def worth(c: Column) -> Column:
            near = F.aggregate(got, F.lit(0.0), lambda m, g: F.greatest(m, _likeness(c["term"], g["term"])))
            value = F.lit(1 - diversity) * -c["neg"] - F.lit(diversity) * near
            return F.struct((-F.round(value, 9)).alias("o"), c["neg"].alias("neg"), c["term"].alias("term"))

        open_ = F.filter(pool, lambda c: ~F.exists(got, lambda g: g["term"] == c["term"]))
        best = F.array_min(F.transform(open_, worth))
        return F.when(best.isNull(), got).otherwise(
            F.concat(got, F.array(F.struct(best["neg"].alias("neg"), best["term"].alias("term")))))

    def walk(acc: Column, c: Column) -> Column:
        words = F.split(c["term"], " ")
        take = (F.size(acc["got"]) < k) & ~F.arrays_overlap(acc["words"], words)
        more = F.struct(F.concat(acc["got"], F.array(c)).alias("got"), F.concat(acc["words"], words).alias("words"))
        return F.when(take, more).otherwise(acc)

    start = F.array().cast("array<struct<neg:double,term:string>>")
    in_full = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step)).otherwise(start)
    if diversity <= 2 / 3:
        return in_full
    none = F.struct(start.alias("got"), F.array().cast("array<string>").alias("words"))
    apart = F.aggregate(pool, none, walk, lambda acc: acc["got"])
    return let(apart, lambda got: F.when((F.size(got) >= k) | (F.size(got) == F.size(pool)), got).otherwise(in_full))


def extract_keywords(docs: DataFrame, idf: Column, text: str = "content", diversity: float | None = DIVERSITY,
                     buckets: int = ft.BUCKETS, hash_name: str = "xxhash64") -> DataFrame:
    """(document_id, keyword, score) rows; the number follows the text length. Whole texts are read. No shuffle."""
    found = candidates(docs, idf, text, buckets, hash_name).withColumn("_k", tx.keyword_budget(tx.word_count(F.col(text))))
    if diversity is None:
        chosen = F.slice("_cand", 1, F.col("_k"))
    else:
        chosen = diversify(F.col("_cand"), F.col("_k"), diversity)
    return found.select("document_id", F.explode(chosen).alias("c")).select(
        "document_id", F.col("c.term").alias("keyword"), (-F.col("c.neg")).alias("score")
    )
