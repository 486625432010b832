"""Categorical vocabularies, encodings and importance; hashed text vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import FEATURE_WEIGHTS, MULTI_VALUED
from ..session import materialise

# Fields of a document that are no categories.
NOT_CATEGORICAL = (
    "id", "celex_number", "title", "summary", "total_words", "summary_word_count", "tier", "date_of_document",
    "date_of_effect", "date_of_end_validity", "keywords",
)
ENTROPY_SHARE, COVERAGE_SHARE = 0.7, 0.3


def feature_rows(docs: DataFrame, features: Sequence[str] | None = None, key: str = "id",
                 multi: Sequence[str] = MULTI_VALUED) -> DataFrame:
    """(key, feature, value) rows. Single-valued features give their (first) value; codes come out of structs."""
    features = features or [c for c in docs.columns if c not in NOT_CATEGORICAL and c != key]

    def pairs(name: str) -> Column:
        kind, col = docs.schema[name].dataType.simpleString(), F.col(name)
        if kind.startswith("array<struct"):
            col = F.transform(col, lambda s: s["code"])
        elif not kind.startswith("array"):
            col = F.array(col.cast("string"))
        values = F.array_compact(col if name in multi else F.slice(col, 1, 1))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("feature"), v.cast("string").alias("value")))

    parts = [F.coalesce(pairs(n), F.array().cast("array<struct<feature:string,value:string>>")) for n in features]
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(F.flatten(F.array(*parts))).alias("fv"))
    return rows.select("doc_id", "fv.feature", "fv.value").filter(F.col("value") != "")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(feature, value, position): distinct values of each feature numbered from 0 in their order, written.

    Values are dealt out to ranges in order and numbered inside their range; what a range must add is a sum over one
    row for each feature and range. A feature of any number of values is spread over many ranges.
    """
    ordered = rows.select("feature", "value").distinct().repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    numbered = materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    placed = numbered.withColumn("part", F.shiftright("id", 33))
    parts = placed.groupBy("feature", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    position = (F.col("id") - F.col("first") + F.col("start")).cast("int")
    return placed.join(starts, ["feature", "part"]).select("feature", "value", position.alias("position"))


def dimensions(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("feature").agg(F.count("*").alias("dims"))


def categories(features: Column, weights: Mapping[str, float] = FEATURE_WEIGHTS, multi: Sequence[str] = MULTI_VALUED) -> Column:
    """A map<string,array<string>> as its weighted values, array<struct<c,w>>: no vocabulary, whatever their number.

    A list on a single-valued feature counts with its first element.
    """
    weight = F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w))))) if weights else None
    held = lambda e: F.when(e["key"].isin(*multi), e["value"]).otherwise(F.slice(e["value"], 1, 1))
    w = lambda e: F.coalesce(F.try_element_at(weight, e["key"]), F.lit(1.0)) if weights else F.lit(1.0)
    empty = F.array().cast("array<struct<c:string,w:double>>")
    one = lambda e: F.transform(F.array_distinct(F.array_compact(held(e))), lambda v: F.struct(category(e["key"], v).alias("c"), w(e).alias("w")))
    return F.coalesce(F.flatten(F.transform(F.map_entries(features), lambda e: F.coalesce(one(e), empty))), empty)


def category(feature: Column, value: Column) -> Column:
    """Feature and value as one string."""
    return F.concat(feature, F.lit("\t"), value)


def shared_weight(a: Column, b: Column) -> Column:
    """Inner product of two rows of categories."""
    known = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(known, x["c"]), F.lit(0.0)))


def scaled_to(cats: Column, length: float) -> Column:
    """Categories with weights of this length together; without any weight they stay as they are."""
    square = F.aggregate(cats, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    by = F.when(square > 0, F.lit(float(length)) / F.sqrt(square)).otherwise(F.lit(1.0))
    return F.transform(cats, lambda x: F.struct(x["c"].alias("c"), (x["w"] * by).alias("w")))


def encode_vectors(df: DataFrame, vocab: DataFrame, key: str = "doc_id", features: str = "features",
                   weights: Mapping[str, float] = FEATURE_WEIGHTS, multi: Sequence[str] = MULTI_VALUED) -> DataFrame:
    """(key, size, indices, cells): one weighted sparse vector over all features of a map<string,array<string>>.

    ``key`` is unique. Features stand in order of their names, values in order of their positions; ``size`` is the number
    of all values. Values meet the vocabulary by join, so neither it nor a dense row is ever in one place.
    """
    of_feature = dimensions(vocab)
    start = F.coalesce(F.sum("dims").over(Window.orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each feature
    starts = of_feature.withColumn("start", start).select("feature", "start")
    size = of_feature.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0]
    cells = vocab.join(starts, "feature").select(category(F.col("feature"), F.col("value")).alias("c"), (F.col("start") + F.col("position")).cast("int").alias("i"))
    own = df.select(key, F.explode(categories(F.col(features), weights, multi)).alias("x")).select(key, F.col("x.c").alias("c"), F.col("x.w").alias("w"))
    met = own.join(cells, "c").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("_x"))
    out = df.select(key).join(met, key, "left").withColumn("_x", F.coalesce("_x", F.array().cast("array<struct<i:int,w:double>>")))
    return out.select(key, F.lit(size).alias("size"), F.transform("_x", lambda x: x["i"]).alias("indices"), F.transform("_x", lambda x: x["w"]).alias("cells"))


def encode_dense(df: DataFrame, vocab: DataFrame, features: str = "features", out: str = "vector",
                 weights: Mapping[str, float] = FEATURE_WEIGHTS, multi: Sequence[str] = MULTI_VALUED, key: str = "doc_id") -> DataFrame:
    """``df`` with its vectors as dense arrays: a cell for each value, so for vocabularies a row can hold."""
    sparse = encode_vectors(df, vocab, key, features, weights, multi)
    held = F.map_from_arrays("indices", "cells")
    cells = F.sequence(F.lit(0), F.col("size") - 1)
    dense = F.when(F.col("size") > 0, F.transform(cells, lambda i: F.coalesce(F.try_element_at(held, i.cast("int")), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    return df.drop(out).join(sparse.select(key, dense.alias(out)), key)


def encode_sparse(rows: DataFrame, vocab: DataFrame, weights: Mapping[str, float] = FEATURE_WEIGHTS) -> DataFrame:
    """Sparse encoding rows (doc_id, feature, position, weight) for vocabularies of any size."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("feature") == name, F.lit(float(w))).otherwise(weight)
    return rows.distinct().join(vocab, ["feature", "value"]).select("doc_id", "feature", "position", weight.alias("weight"))


def importance(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """0.7 * entropy + 0.3 * coverage per feature, divided by the largest.

    Counted per value first, so one feature present in every document still meets the second step as one row per value.
    """
    total = docs.agg(F.count("*").alias("n")).scalar()
    per_value = rows.groupBy("feature", "value").agg(F.count("*").alias("n"))
    stats = per_value.groupBy("feature").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nlogn")
    )
    # H = ln N - (1/N) * sum n ln n
    entropy = F.ln("total") - F.col("nlogn") / F.col("total")
    covered = rows.select("feature", "doc_id").distinct().groupBy("feature").agg(F.count("*").alias("covered"))
    raw = F.lit(ENTROPY_SHARE) * entropy + F.lit(COVERAGE_SHARE) * F.col("covered") / total
    scored = stats.join(covered, "feature").select("feature", raw.alias("raw"))
    top = F.max("raw").over(Window.partitionBy())
    return scored.select("feature", F.round(F.col("raw") / top, 6).alias("importance"))


# -- text vectors --------------------------------------------------------------------------------------------

BUCKETS = 1 << 18


def bucket(term: Column, buckets: int = BUCKETS, hash_name: str = "xxhash64") -> Column:
    """Hash bucket of a term. ``md5`` gives the same bucket in other SQL engines."""
    if hash_name == "md5":
        return F.pmod(F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def hashed_counts(toks: Column, buckets: int = BUCKETS, hash_name: str = "xxhash64") -> Column:
    """array<struct<b,tf>> of a token array: tokens to buckets, then counted in the row."""
    hashed = F.transform(toks, lambda t: bucket(t, buckets, hash_name))
    return F.transform(tx.term_counts(hashed, "int"), lambda t: F.struct(t["term"].alias("b"), t["tf"].alias("tf")))


def idf_table(docs: DataFrame, toks: Column, buckets: int = BUCKETS, hash_name: str = "xxhash64") -> DataFrame:
    """(b, df, idf) with idf = ln((N + 1) / (df + 1)). At most ``buckets`` rows, whatever the corpus size."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    present = docs.select(F.explode(F.array_distinct(F.transform(toks, lambda t: bucket(t, buckets, hash_name)))).alias("b"))
    return present.groupBy("b").agg(F.count("*").alias("df")).withColumn("idf", F.ln((n + 1) / (F.col("df") + 1)))


def idf_array(idf: DataFrame, docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The idf table as one row holding one array indexed by bucket, of bounded size (2 MB at 2^18 buckets).

    Buckets no document falls in hold ln(N + 1).
    """
    spark = idf.sparkSession
    n = docs.agg(F.count("*").alias("n")).scalar()
    dense = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(idf, "b", "left").select(
        "b", F.coalesce("idf", F.ln(n + 1)).alias("idf")
    )
    ordered = dense.agg(F.sort_array(F.collect_list(F.struct("b", "idf"))).alias("a"))
    return ordered.select(F.transform("a", lambda x: x["idf"]).alias("a"))


def tfidf(counts: Column, idf: Column) -> Column:
    """array<struct<b,w>>: term frequency times idf."""
    return F.transform(counts, lambda c: F.struct(c["b"].alias("b"), (c["tf"] * F.element_at(idf, c["b"] + 1)).alias("w")))


def text_vector_rows(docs: DataFrame, key: str, toks: Column, idf: Column, buckets: int = BUCKETS,
                     hash_name: str = "xxhash64") -> DataFrame:
    """Unit-length sparse text vectors as rows (key, b, w). A vector is made inside its row: no shuffle.

    ``idf``: the bounded array column of extractive.corpus_idf.
    """
    held = docs.withColumn("_idf", idf).withColumn("_w", tfidf(hashed_counts(toks, buckets, hash_name), F.col("_idf"))).drop("_idf")
    length = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    rows = held.withColumn("_len", length).select(key, F.explode(F.transform("_w", lambda x: x)).alias("x"), "_len")
    return rows.select(key, "x.b", F.coalesce(F.try_divide(F.col("x.w"), F.col("_len")), F.lit(0.0)).alias("w"))


def text_encoder(docs: DataFrame, tokens_col: str, dim: int = 256):
    """Fit the default text encoder on a corpus and return ``encode(df, tokens_col, out)``.

    Hashing, inverse document frequency and unit length from Spark ML: all in the JVM, one bounded model of
    ``dim`` numbers, no vocabulary. The same encoder serves documents and queries.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def counts(df: DataFrame, col: str) -> DataFrame:
        return HashingTF(inputCol=col, outputCol="_tf", numFeatures=dim).transform(df)

    model = IDF(inputCol="_tf", outputCol="_w").fit(counts(docs.select(tokens_col), tokens_col))

    def encode(df: DataFrame, col: str, out: str = "vector") -> DataFrame:
        weighted = Normalizer(inputCol="_w", outputCol="_u").transform(model.transform(counts(df, col)))
        return weighted.withColumn(out, vector_to_array("_u")).drop("_tf", "_w", "_u")

    return encode
