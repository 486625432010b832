"""Length distributions: exact quantiles, outliers, thresholds, density.

Everything starts from a frequency table ``(group…, value, n)``. Lengths are whole numbers, so that table is far smaller
than the corpus whatever its size, it is built with map-side combine, and quantiles stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Z thresholds swept, percentiles shown, density grid points.
Z_THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)
PERCENTILES = (25, 50, 75, 90, 95, 99)
GRID_POINTS = 1000


def frequencies(df: DataFrame, value: str, *groups: str) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    )


def _count() -> Column:
    return F.sum("n")


def _mean() -> Column:
    return F.sum(F.col("value") * F.col("n")).cast("double") / F.sum("n")


def _sample_std() -> Column:
    """Sample deviation from whole-number sums held as decimals: exact until the last step, no cancellation."""
    whole = "decimal(38,0)"
    square = (F.col("value") * F.col("value")).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    n = F.sum("n").cast(whole)
    s1 = F.sum(F.col("value") * F.col("n")).cast(whole)
    s2 = F.sum(square).cast(whole)
    top = (n * s2 - s1 * s1).cast("double")
    count = F.sum("n").cast("double")
    return F.when(count > 1, F.sqrt(top / (count * (count - 1))))


def _quantile(q: float) -> Column:
    return F.percentile("value", F.lit(q), F.col("n"))


def describe(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max."""
    return frequencies(df, value, *groups).groupBy(*groups).agg(
        _count().alias("n"),
        F.round(_mean(), 6).alias("mean"),
        F.round(_sample_std(), 6).alias("std"),
        F.min("value").alias("min"),
        F.round(_quantile(0.25), 6).alias("p25"),
        F.round(_quantile(0.5), 6).alias("median"),
        F.round(_quantile(0.75), 6).alias("p75"),
        F.round(_quantile(0.95), 6).alias("p95"),
        F.max("value").alias("max"),
    )


def length_profile(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """``describe`` of several measures per group in one scan: (group, measure, …)."""
    long = df.select(group, *measures).unpivot([group], list(measures), "measure", "length")
    return describe(long, "length", group, "measure")


def percentiles(df: DataFrame, value: str, points: Sequence[int] = PERCENTILES) -> DataFrame:
    """Global percentiles as rows."""
    wanted = F.percentile("value", F.array(*(F.lit(p / 100.0) for p in points)), F.col("n"))
    arr = frequencies(df, value).agg(wanted.alias("v"))
    return arr.select(F.posexplode("v").alias("i", "v")).select(
        F.element_at(F.array(*(F.lit(p) for p in points)), F.col("i") + 1).alias("percentile"), F.round("v", 6).alias("value")
    )


def corpus_stats(df: DataFrame, value: str = "total_words") -> DataFrame:
    return df.agg(
        F.count("*").alias("documents"), F.round(F.avg(value), 6).alias("avg_words"),
        F.min(value).alias("min_words"), F.max(value).alias("max_words"),
    )


def _with_z(freq: DataFrame) -> DataFrame:
    """Frequency rows with their z score; mean and deviation come as scalar subqueries over the frequency table."""
    stats = freq.agg(F.struct(_mean().alias("m"), _sample_std().alias("s")).alias("st"))
    st = stats.scalar()
    return freq.withColumn("z", F.try_divide(F.col("value") - st["m"], st["s"]))


def iqr_bounds(freq: DataFrame, k: float = 1.5) -> DataFrame:
    q = freq.agg(_quantile(0.25).alias("q1"), _quantile(0.75).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - k * spread).alias("low"), (F.col("q3") + k * spread).alias("high"))


def iqr_outliers(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """Bounds Q1 - k IQR and Q3 + k IQR, number of values outside and their share."""
    freq = frequencies(df, value)
    b = iqr_bounds(freq, k).select(F.struct("low", "high").alias("b")).scalar()
    tagged = freq.withColumn("b", b)
    outside = (F.col("value") < F.col("b.low")) | (F.col("value") > F.col("b.high"))
    return tagged.agg(
        F.round(F.max("b.low"), 6).alias("low"), F.round(F.max("b.high"), 6).alias("high"),
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"),
        F.round(F.sum(F.when(outside, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 6).alias("outlier_pct"),
    )


def iqr_outlier_rows(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    b = iqr_bounds(frequencies(df, value), k).select(F.struct("low", "high").alias("b")).scalar()
    return df.filter((F.col(value) < b["low"]) | (F.col(value) > b["high"]))


def z_outliers(df: DataFrame, value: str, thresholds: Sequence[float] = (3.0,)) -> DataFrame:
    """Per threshold: outliers, retained, retained %, and the range of retained values.

    Each frequency row is repeated once per threshold (a handful), not each document.
    """
    z = _with_z(frequencies(df, value))
    swept = z.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    kept = F.abs("z") <= F.col("threshold")
    return swept.groupBy("threshold").agg(
        F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("outliers"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("retained"),
        F.round(F.sum(F.when(kept, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 6).alias("retained_pct"),
        F.min(F.when(kept, F.col("value"))).alias("min_retained"),
        F.max(F.when(kept, F.col("value"))).alias("max_retained"),
    )


def z_for_retention(df: DataFrame, value: str, target: float = 0.95) -> DataFrame:
    """The |z| threshold that keeps ``target`` of the values, and what it keeps."""
    z = _with_z(frequencies(df, value)).withColumn("az", F.abs("z"))
    cut = z.agg(F.percentile("az", F.lit(target), F.col("n")).alias("c")).scalar()
    tagged = z.withColumn("cut", cut)
    kept = F.sum(F.when(F.col("az") <= F.col("cut"), F.col("n")).otherwise(0))
    return tagged.agg(
        F.round(F.max("cut"), 6).alias("threshold"), kept.alias("retained"),
        F.round(kept * 100.0 / F.sum("n"), 6).alias("retained_pct"),
    )


def over_limit(df: DataFrame, value: str, group: str, limit: int) -> DataFrame:
    """Per group: values at or over a limit, and all values."""
    return df.groupBy(group).agg(
        F.count_if(F.col(value) >= limit).alias("over_limit"), F.count("*").alias("documents")
    )


def split_at(df: DataFrame, value: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) at a fixed limit."""
    return df.filter(F.col(value) < limit), df.filter(F.col(value) >= limit)


def retained_counts(df: DataFrame, value: str, limit: int) -> DataFrame:
    kept = F.count_if(F.col(value) < limit)
    return df.agg(
        kept.alias("retained"), F.count_if(F.col(value) >= limit).alias("excluded"),
        F.round(kept * 100.0 / F.count("*"), 6).alias("retained_pct"),
    )


def per_document_counts(sections: DataFrame) -> DataFrame:
    """Sections per document: mean and median."""
    counts = sections.groupBy("document_id").agg(F.count("*").alias("value"))
    freq = counts.groupBy("value").agg(F.count("*").alias("n"))
    return freq.agg(
        _count().alias("documents"), F.round(_mean(), 6).alias("mean_sections"), F.round(_quantile(0.5), 6).alias("median_sections")
    )


def density(df: DataFrame, value: str, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid from 0 to the maximum.

    A frequency row only reaches the grid points within 39 bandwidths; farther ones get exactly 0 in double
    precision, so leaving them out changes nothing.
    """
    freq = frequencies(df, value)
    st = freq.agg(
        F.struct(
            F.sum("n").cast("double").alias("n"), _sample_std().alias("s"), F.max("value").cast("double").alias("top")
        ).alias("st")
    ).scalar()
    h = st["s"] * F.pow(st["n"], F.lit(-0.2))
    tagged = freq.withColumn("h", h).withColumn("total", st["n"]).withColumn("step", st["top"] / (points - 1))
    reach = F.lit(39.0) * F.col("h")
    first = F.greatest(F.lit(0), F.ceil((F.col("value") - reach) / F.col("step")).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("value") + reach) / F.col("step")).cast("int"))
    spread = tagged.filter(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    x = F.col("i") * F.col("step")
    u = (x - F.col("value")) / F.col("h")
    mass = F.col("n") * F.exp(-u * u / 2) / (F.col("total") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.groupBy("i", "step").agg(F.sum(mass).alias("density")).select(
        "i", (F.col("i") * F.col("step")).alias("x"), "density"
    )


def density_peaks(df: DataFrame, value: str, points: int = GRID_POINTS) -> DataFrame:
    """Local maxima of the density (the window runs over the grid, at most ``points`` rows)."""
    w = Window.partitionBy().orderBy("i")
    grid = density(df, value, points).withColumns(
        {"_before": F.lag("density").over(w), "_after": F.lead("density").over(w)}
    )
    peak = (F.col("density") > F.col("_before")) & (F.col("density") > F.col("_after"))
    return grid.filter(peak).select("i", F.floor("x").alias("length"), "density")
