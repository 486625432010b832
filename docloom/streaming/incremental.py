"""Incremental versions of ingest, feedback and counters.

Every query takes a checkpoint folder all executors reach, so it resumes after a restart where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.bucketed import BucketedTable
from ..sources.writers import latest


def append_new(base: str, key: str = "celex_number", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch handler: rows whose key has not come before are added to the bucketed table in ``base``.

    What has come before is looked up in the buckets of the batch's keys, so a batch costs what its buckets cost and no
    key is ever forgotten. Nothing depends on batch numbers: a repeated batch finds its keys and adds nothing, and a job
    that starts with a new checkpoint over the same table adds what is missing. Of rows that share a key one is kept.
    """

    def handle(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # looked at for its buckets, then written
        BucketedTable(batch.sparkSession, base, [key], batch.schema, buckets).append_new(held)
        held.unpersist()

    return handle


def read_new(spark: SparkSession, base: str, schema: StructType, key: str = "celex_number") -> DataFrame:
    return BucketedTable(spark, base, [key], schema).read()


def running_ratings(stream: DataFrame) -> DataFrame:
    """Rating statistics per document, updated with every event (a few numbers of state per document)."""
    return stream.groupBy("document_id").agg(
        F.count("*").alias("ratings"), F.round(F.avg("rating"), 6).alias("avg_rating"),
        *(F.count_if(F.col("rating") == r).alias(f"rated_{r}") for r in range(1, 6)),
    )


def daily_counts(stream: DataFrame, at: str, status: str, delay: str = "1 day") -> DataFrame:
    """Events per day and status, kept current in update mode; the state of a day goes once the watermark has passed it."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, "1 day").alias("w"), status).agg(F.count("*").alias("n"))
        .select(F.to_date("w.start").alias("day"), status, "n")
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available into a Parquet table and stop; exactly once, by the file sink's log."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_batches(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
        .trigger(availableNow=True).start()
    )


class KeyedTable:
    """A table kept current by micro-batches: a log of folded batches, one folder per batch number.

    A batch only writes its own rows, reduced to the last one per key, so the cost of a batch follows the batch and
    not the table. Replaying a batch after a failure rewrites the same folder with the same rows. Readers take the
    last row per key by ``order``, whatever batch it came in, or without an order the newest batch; ``compact`` folds the
    log into a new base when it has grown.
    """

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str], order: Sequence[str] = ()):
        self.spark, self.base, self.keys, self.order = spark, base, list(keys), list(order)

    def fold(self, batch: DataFrame, number: int) -> None:
        rows = latest(batch, self.keys, self.order) if self.order else batch
        rows.write.mode("overwrite").parquet(f"{self.base}/batch={number}")

    def read(self) -> DataFrame:
        log = self.spark.read.parquet(self.base)
        return latest(log, self.keys, [*self.order, "batch"]).drop("batch")

    def compact(self, to: str) -> "KeyedTable":
        self.read().write.mode("overwrite").parquet(f"{to}/batch=-1")
        return KeyedTable(self.spark, to, self.keys, self.order)
