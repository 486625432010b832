"""Token-budget batches in length buckets whose borders make the padding of the whole corpus smallest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

SPACE = r"[\t\n\x0B\f\r ]+"


def word_count(text: str) -> Column:
    """Words between ASCII white space; 0 for null and blank texts."""
    solid = F.btrim(F.col(text), F.lit("\t\n\x0b\f\r "))
    return F.when(F.length(solid) > 0, F.size(F.split(solid, SPACE))).otherwise(0).cast("long")


def optimal_borders(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper borders of at most ``buckets`` buckets with the least padding over the histogram (of equals, the lowest borders last to first).

    ``best[j]`` after round k is the padded size of the j shortest lengths in k buckets.
    """
    order = np.argsort(lengths)
    size = np.array(lengths, np.int64)[order]
    total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[order])])
    n = len(size)
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (total[j] - total[:j])
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
    borders, j = [], n
    for cut in reversed(cuts):
        borders.append(int(size[j - 1]))
        j = int(cut[j])
    return borders[::-1]


def pack(docs: DataFrame, length: Column | None = None, max_tokens: int = 2048, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, piece, start, n_tokens, bucket (padded length), batch, slot.

    ``length``: tokens of a row (words by default). A document longer than ``max_tokens`` is cut into pieces of that
    length and a rest; every token is in one piece. Each piece goes to the first bucket it fits; a batch of a bucket
    holds as many pieces as ``budget`` tokens allow after padding, at least one, in order of doc_id and piece; only the
    last batch of a bucket may have room left. Documents without tokens have one row with bucket, batch and slot null.
    Rows are kept apart even if they repeat. Other columns are not read. No rows: no rows.

    The histogram has ``max_tokens`` entries at most and is all that reaches the driver. Places in a bucket come from a
    range partitioning and one count for each partition, so no bucket is numbered in one task.
    """
    sized = docs.select("doc_id", (word_count("text") if length is None else length).cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / max_tokens) - 1).cast("int")
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * F.lit(max_tokens).cast("long")).alias("start"),
        F.least(F.lit(max_tokens).cast("long"), F.col("n") - F.col("piece") * max_tokens).alias("n_tokens"))
    pieces = written(pieces, "pieces")
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()
    borders = optimal_borders([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    fits = F.array(*map(F.lit, borders)).cast("array<long>") if borders else F.array().cast("array<long>")
    bucketed = pieces.withColumn("bucket", F.when(F.col("n_tokens") > 0, F.element_at(F.filter(fits, lambda b: b >= F.col("n_tokens")), 1)))
    full = bucketed.where("bucket IS NOT NULL")
    order = ["bucket", "doc_id", "piece", "n_tokens"]
    placed = written(full.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = placed.groupBy("bucket", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    parts = parts.select("bucket", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    nth = F.col("at") + F.col("shift")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    batched = placed.withColumn("part", part).join(parts, ["bucket", "part"]).select(
        "doc_id", "piece", "start", "n_tokens", "bucket", F.floor(nth / room).alias("batch"), F.pmod(nth, room).alias("slot"))
    none = bucketed.where("bucket IS NULL").select("doc_id", "piece", "start", "n_tokens", "bucket", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot"))
    return batched.unionByName(none)
