"""Extractive summaries: sentence scores, budgeted picks, and the tier recipes built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunking as ck
from ..functions import text as tx
from ..functions.text import let
from ..session import materialise
from . import features as ft

TOLERANCE = 0.1
SHARE_RANGE = (0.15, 0.35)


def corpus_idf(docs: DataFrame, text: str = "content", buckets: int = ft.BUCKETS, hash_name: str = "xxhash64") -> Column:
    """Inverse document frequencies of a corpus as one bounded array column (see features.idf_array).

    Fitted once: the array (one row, 2 MB at most) is written to the shared folder, so that a job using it several
    times scans the corpus for it a single time.
    """
    toks = tx.tokens(F.col(text))
    dense = ft.idf_array(ft.idf_table(docs, toks, buckets, hash_name), docs, buckets)
    return materialise(dense, "idf").scalar()


def with_idf(df: DataFrame, idf: Column) -> DataFrame:
    """The idf array as column ``_idf``, for use once in the next projection.

    A lambda may not name a subquery itself. Used once, the optimizer folds the column back into that projection, so
    the array is never copied into rows (the plan shows one Project with the subquery inside).
    """
    return df.withColumn("_idf", idf)


def sentence_score(sentence: Column, idf: Column, buckets: int = ft.BUCKETS, hash_name: str = "xxhash64") -> Column:
    """Length of the sentence's tf-idf vector; 0 for a sentence without terms."""
    weights = ft.tfidf(ft.hashed_counts(tx.tokens(sentence), buckets, hash_name), idf)
    return F.sqrt(F.aggregate(weights, F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))


def scored_sentences(text: Column, idf: Column, buckets: int = ft.BUCKETS, hash_name: str = "xxhash64") -> Column:
    """array<struct<neg,i,words,t>>: sorts into best-first order as it stands."""
    return F.transform(
        tx.sentences(text),
        lambda t, i: F.struct(
            (-F.round(sentence_score(t, idf, buckets, hash_name), 6)).alias("neg"), i.alias("i"),
            tx.word_count(t).alias("words"), t.alias("t"),
        ),
    )


def pick(scored: Column, target: Column) -> Column:
    """Best sentences around ``target`` words, in text order.

    Best first, a sentence is taken if the total stays within 110 % of the target, until 90 % is reached. If that
    still misses the target by over 10 % (short targets, rounding), the next sentence that fits is added.
    """
    low, high = F.floor(target * (1 - TOLERANCE)).cast("int"), F.floor(target * (1 + TOLERANCE)).cast("int")
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("got"), F.lit(False).alias("full"))

    def take(acc: Column, s: Column, closes: Column) -> Column:
        return F.struct((acc["n"] + s["words"]).alias("n"), F.concat(acc["got"], F.array(s["i"])).alias("got"), closes.alias("full"))

    def main(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + s["words"] <= high)
        return F.when(fits, take(acc, s, acc["n"] + s["words"] >= low)).otherwise(acc)

    def top_up(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & ~F.array_contains(acc["got"], s["i"]) & (acc["n"] + s["words"] <= high)
        return F.when(fits, take(acc, s, F.lit(True))).otherwise(acc)

    def choose(ordered: Column) -> Column:
        def finish(acc: Column) -> Column:
            short = (target - acc["n"]) > target * TOLERANCE
            again = F.struct(acc["n"].alias("n"), acc["got"].alias("got"), F.lit(False).alias("full"))
            return F.when(short & acc["full"], F.aggregate(ordered, again, top_up)["got"]).otherwise(acc["got"])

        return let(F.aggregate(ordered, none, main), finish)

    def text_of(got: Column) -> Column:
        return F.array_join(F.transform(F.filter(scored, lambda s: F.array_contains(got, s["i"])), lambda s: s["t"]), " ")

    return let(let(F.sort_array(scored), choose), text_of)


def extract(df: DataFrame, text: str, target: Column, idf: Column, out: str = "extract", buckets: int = ft.BUCKETS,
            hash_name: str = "xxhash64") -> DataFrame:
    """Extract of about ``target`` words per row; texts without sentences stay as they are. No shuffle."""
    scored = with_idf(df, idf).withColumn("_scored", scored_sentences(F.col(text), F.col("_idf"), buckets, hash_name)).drop("_idf")
    picked = pick(F.col("_scored"), target)
    return scored.withColumn(out, F.when(F.size("_scored") > 0, picked).otherwise(F.coalesce(text, F.lit("")))).drop("_scored")


def _chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    """Chunks as rows; a document without any keeps one row, so that it is not lost."""
    rows = docs.select("document_id", F.posexplode_outer(chunks).alias("pos", "chunk"))
    return rows.withColumn("words", tx.word_count(F.col("chunk")))


def _joined(rows: DataFrame, piece: str, order: Sequence[str] = ("pos",), separator: str = " ") -> DataFrame:
    """Extracts of one document in order: what is gathered are the short extracts, not the text."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, piece)))
    kept = F.filter(F.transform(ordered, lambda s: s[piece]), lambda s: s != "")
    return rows.groupBy("document_id").agg(F.array_join(kept, separator).alias("extract"))


def second_tier(docs: DataFrame, idf: Column, text: str = "content") -> DataFrame:
    """Chunks along the text's structure, a falling share from each, joined: (document_id, extract)."""
    rows = _chunk_rows(docs, ck.chunk(F.col(text)))
    target = F.floor(F.col("words") * ck.chunk_share(F.col("pos"))).cast("int")
    return _joined(extract(rows, "chunk", target, idf), "extract")


def third_tier_chunks(sections: DataFrame) -> DataFrame:
    """Section chunks with their position weight: (document_id, section_order, pos, chunk, words, weight).

    Up to 350 words a section stays as it is, up to 750 it is split, up to 1500 it stays whole, and a longer one is
    split into larger parts that are split again.
    """
    held = sections.withColumn("_n", tx.word_count(F.col("content")))
    size = F.least(tx.balanced_chunk_size(F.col("_n")), F.when(F.col("_n") <= 750, 350).otherwise(750)).cast("int")
    whole = (F.col("_n") <= 350) | F.col("_n").between(751, 1500)
    held = held.withColumn("_size", F.when(whole, F.greatest(F.col("_n"), F.lit(1))).otherwise(size))
    held = held.withColumn("_c", ck.chunk(F.col("content"), F.col("_size")))
    twice = F.flatten(F.transform("_c", lambda c: ck.chunk_again(c)))
    held = held.withColumn("_c", F.when(F.col("_n") > 1500, twice).otherwise(F.col("_c")))
    zipped = F.arrays_zip(F.col("_c").alias("chunk"), ck.middle_weights(F.size("_c")).alias("weight"))
    rows = held.select("document_id", "section_order", F.posexplode(zipped).alias("pos", "z"))
    return rows.select(
        "document_id", "section_order", "pos", F.col("z.chunk").alias("chunk"),
        tx.word_count(F.col("z.chunk")).alias("words"), F.col("z.weight").alias("weight"),
    )


def weighted_share(words_total: Column, weight: Column, target: int) -> Column:
    """target / total * weight, held within 0.15..0.35; factor 0.5 when there are no words."""
    factor = F.when(words_total > 0, F.lit(float(target)) / words_total).otherwise(0.5)
    return F.greatest(F.lit(SHARE_RANGE[0]), F.least(F.lit(SHARE_RANGE[1]), factor * weight))


def third_tier(sections: DataFrame, idf: Column, target: int = 700) -> DataFrame:
    """Weighted extraction over all chunks of a document towards ``target`` words: (document_id, extract)."""
    rows = third_tier_chunks(sections)
    total = F.sum("words").over(Window.partitionBy("document_id"))
    shared = rows.withColumn("share", weighted_share(total, F.col("weight"), target))
    picked = extract(shared, "chunk", F.floor(F.col("words") * F.col("share")).cast("int"), idf)
    return _joined(picked, "extract", ("section_order", "pos"))


def fourth_tier(docs: DataFrame, idf: Column, text: str = "content", target: int = 750) -> DataFrame:
    """Two passes for very long texts: each section down to 600 words or less, then a weighted pass over the sections."""
    parts = docs.select("document_id", F.posexplode_outer(ck.long_sections(F.col(text))).alias("pos", "section"))
    sub = parts.withColumn("words", tx.word_count(F.col("section"))).select(
        "document_id", "pos", "words",
        F.posexplode(F.when(F.col("words") <= 1500, F.array("section")).otherwise(ck.subsections(F.col("section")))).alias("sub", "part"),
    )
    first = extract(sub, "part", F.lit(600), idf, "_x").withColumn("piece", F.when(F.col("words") <= 750, F.col("part")).otherwise(F.col("_x")))
    per_section = first.groupBy("document_id", "pos").agg(F.sort_array(F.collect_list(F.struct("sub", "piece"))).alias("_p"))
    chunks = per_section.select("document_id", "pos", F.array_join(F.transform("_p", lambda p: p["piece"]), "\n").alias("chunk")).withColumn(
        "words", tx.word_count(F.col("chunk"))
    )
    by_doc = Window.partitionBy("document_id")
    factor = F.greatest(F.lit(SHARE_RANGE[0]), F.lit(float(target)) / F.greatest(F.sum("words").over(by_doc), F.lit(1)))
    rank = F.row_number().over(by_doc.orderBy("pos")) - 1
    share = F.greatest(F.lit(SHARE_RANGE[0]), F.least(F.lit(SHARE_RANGE[1]), factor * ck.position_weight(rank)))
    rows = chunks.withColumn("share", share)
    return _joined(extract(rows, "chunk", F.floor(F.col("words") * F.col("share")).cast("int"), idf), "extract")


def fixed_share(docs: DataFrame, idf: Column, target: int, text: str = "content") -> DataFrame:
    """Chunks of up to 1000 words, a fixed share of each, then shrink passes while over 1.5 times the target.

    A pass leaves a row at most 110 % of the larger of its target and 15 % of its words, so the longest text of the
    corpus says how many passes bring every row down; a row already short enough is left alone by every pass.
    """
    rows = _chunk_rows(docs, ck.sentence_chunks(F.col(text)))
    first = _joined(extract(rows, "chunk", F.floor(F.col("words") * ck.chunk_share(F.col("pos"))).cast("int"), idf), "extract")
    out = materialise(first, "shares")
    longest = out.agg(F.max(tx.word_count(F.col("extract")))).first()[0] or 0
    while longest > 1.5 * target:
        longest = longest * SHARE_RANGE[0] * (1 + TOLERANCE)
        n = tx.word_count(F.col("extract"))
        share = F.greatest(F.lit(SHARE_RANGE[0]), F.lit(float(target)) / F.greatest(n, F.lit(1)))
        shrunk = extract(out.withColumn("_n", n), "extract", F.floor(n * share).cast("int"), idf, "_shrunk")
        out = shrunk.select(
            "document_id", F.when(F.col("_n") > target * 1.5, F.col("_shrunk")).otherwise(F.col("extract")).alias("extract")
        )
    return out
