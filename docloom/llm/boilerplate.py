"""Lines that a large share of a site's pages repeat, dropped. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import written

EDGE = " \t\r"  # does not count in comparing lines


def _lines(text: str) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(EDGE)))


def boilerplate_lines(docs: DataFrame, host: str, text: str, ratio: float, least: int) -> DataFrame:
    """host, lines: hashes of the lines that stand on more than ``ratio`` of the host's pages and on ``least`` pages or more.

    A host has at most (lines of a page on average) / ratio of them. Counts are summed before they are shuffled, by host
    and line, so a large host is spread over all tasks.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    solid = F.filter(F.array_distinct(F.transform(_lines("text"), lambda x: F.btrim(x, F.lit(EDGE)))), lambda x: x != "")
    counts = (pages.select("host", F.explode(F.transform(solid, lambda x: F.xxhash64(x))).alias("line"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    common = counts.join(totals.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.03, least: int = 5) -> DataFrame:
    """``docs`` with its boilerplate lines dropped, and two columns more: n_lines, n_dropped.

    Pages are rows, also repeated ones; a line counts once for a page. Lines are compared without blanks at their ends;
    blank lines are neither counted nor dropped. A null host is a site like any other. A null text stays null (0 lines);
    the other lines of a text keep their order and their bytes. A text of boilerplate alone becomes empty: its row stays.
    Columns n_lines and n_dropped of the input, if any, are replaced; all others are kept.
    """
    common = written(boilerplate_lines(docs, host, text, ratio, least), "boilerplate").select(F.col("host").alias("__site"), F.col("lines").alias("__lines"))
    kept = F.filter(_lines(text), lambda x: ~F.array_contains("__lines", _key(x)))
    before = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text)))
    joined = docs.drop("n_lines", "n_dropped").join(common, F.col(host).eqNullSafe(F.col("__site")), "left").withColumn(
        "__kept", F.when(F.col("__lines").isNotNull() & F.col(text).isNotNull(), kept)).withColumn("n_lines", before.cast("long"))
    return joined.withColumn("n_dropped", F.when(F.col("__kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("__kept")).cast("long")).withColumn(
        text, F.when(F.col("n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text))).drop("__site", "__lines", "__kept")
