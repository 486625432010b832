"""User functions over batches of rows, and user models loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_function(func: Callable[[pa.Table], pa.Table], batch_size: int, returns: str):
    """A table function that hands ``func`` the rows of its TABLE argument, ``batch_size`` at a time.

    ``func`` gets a table of at most that many rows and gives one of the type ``returns`` (any number of rows). Where the
    argument is partitioned, a batch holds rows of one key, and the last batch of a key may be smaller. Rows are held
    for one batch only. Register it to use it in SQL: ``spark.udtf.register(name, batch_function(…))``, then
    ``SELECT * FROM name(TABLE(t) PARTITION BY key)``.
    """
    if batch_size < 1:
        raise ValueError("a batch has at least one row")

    class Batches:
        def __init__(self) -> None:
            self.held: list[pa.RecordBatch] = []
            self.rows = 0

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, batch_size - self.rows)
                self.held.append(part)
                self.rows += part.num_rows
                at += part.num_rows
                if self.rows == batch_size:
                    yield from self.terminate()

        def terminate(self) -> Iterator[pa.Table]:
            if self.rows:
                whole = pa.Table.from_batches(self.held)
                self.held, self.rows = [], 0
                yield func(whole)

    return F.arrow_udtf(Batches, returnType=returns)


def process_in_batches(df: DataFrame, func: Callable[[pa.Table], pa.Table], batch_size: int, returns: str,
                       keys: Sequence[str | Column] = (), order: Sequence[str | Column] = ()) -> DataFrame:
    """``func`` over all rows in batches, those of one key together and in ``order``.

    A key's rows are one task's: where a few keys hold most rows, add a hash of the row to the keys.
    """
    if not keys:
        raise ValueError("name the columns whose rows go into a batch together, or a hash that deals them out")
    table = df.asTable().partitionBy(*keys)
    return batch_function(func, batch_size, returns)(table.orderBy(*order) if order else table)


def encoder_udf(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch_size: int = 256):
    """A text encoder as pandas UDF string -> array<double>, for ``plans.index.build_vectors``.

    ``load`` makes the model: it runs once for each task that uses it, not for each batch, and may keep what it loads in
    a module-level place, where later tasks of the worker find it. The model gets up to ``batch_size`` texts in a call;
    nulls are not shown to it and stay null.
    """
    return _mapped(load, batch_size, "array<double>", lambda v: [float(x) for x in v])


def summariser_udf(load: Callable[[], Callable[[list[str]], Sequence[str]]], batch_size: int = 64):
    """A summariser as pandas UDF string -> string, for ``plans.summaries.summarise``; see ``encoder_udf``."""
    return _mapped(load, batch_size, "string", str)


def _mapped(load: Callable, batch_size: int, kind: str, clean: Callable):
    @F.pandas_udf(kind)
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list = [None] * len(texts)
            shown = [i for i, x in enumerate(texts.tolist()) if x is not None]
            for a in range(0, len(shown), batch_size):
                some = shown[a:a + batch_size]
                made = list(model([texts.iloc[i] for i in some]))
                if len(made) != len(some):
                    raise ValueError(f"the model gave {len(made)} results for {len(some)} texts")
                for i, v in zip(some, made):
                    out[i] = clean(v)
            yield pd.Series(out, dtype=object)

    return mapped
