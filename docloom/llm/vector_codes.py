"""Product codes of integer vectors, learned by exact nearest-entry rounds on matrix products.

Squared distances are needed exactly, and the fast matrix product is the floating-point one. So integers are cut into
limbs narrow enough that every product of two limb matrices stays below 2^53, where float64 sums are exact; the products
are put together again in 64-bit integers, and the first entry of least distance is taken.

A round is one pass over the vectors: each task assigns its rows and returns, for each codebook cell, sums and counts
of a fixed size, which Spark adds up. Only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import written

SCALE = 4096
SALTS = 16  # shares of a label's rows that meet its sum in different tasks


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices x0, x1, … with a = x0 + x1 * 2^bits + …; each entry is below 2^bits in size, the last one signed."""
    out = []
    while True:
        if not a.size or (a.min() >= -(1 << bits) and a.max() < (1 << bits)):
            return [*out, a.astype(np.float64)]
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for int64 matrices, exact as long as the result fits 64 bits (else modulo 2^64)."""
    bits = (53 - max(1, a.shape[1]).bit_length()) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            if bits * (i + j) < 64:
                total += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


@dataclass
class Codebooks:
    """For each part of a vector the (start, end) of its components and its entries, entries x components."""

    cuts: list[tuple[int, int]]
    entries: list[np.ndarray]

    @classmethod
    def begin(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        d = vectors.shape[1]
        cuts = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
        return cls(cuts, [vectors[:, a:b].copy() for a, b in cuts])

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (of equals the first), rows x parts, and its squared distance."""
        codes = np.empty((len(vectors), len(self.cuts)), np.int64)
        errors = np.empty_like(codes)
        for p, ((a, b), entries) in enumerate(zip(self.cuts, self.entries, strict=True)):
            x = vectors[:, a:b]
            distance = (x * x).sum(axis=1)[:, None] - 2 * exact_products(x, entries) + (entries * entries).sum(axis=1)
            codes[:, p] = distance.argmin(axis=1)
            errors[:, p] = distance[np.arange(len(x)), codes[:, p]]
        return codes, errors

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _refined(rows: DataFrame, books: Codebooks, d: int) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts nearest to it; an entry without parts stays."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # as large as a few vectors

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        sums = [np.zeros_like(e) for e in held.entries]
        counts = [np.zeros(len(e), np.int64) for e in held.entries]
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            codes, _ = held.assign(x)
            for p, (a, b) in enumerate(held.cuts):
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
                np.add.at(sums[p], codes[:, p], x[:, a:b])
        cells = [(p, e, i, int(counts[p][e]), int(s)) for p, t in enumerate(sums) for e in range(len(t)) if counts[p][e] for i, s in enumerate(t[e])]
        if cells:
            part, entry, at, n, total = zip(*cells, strict=True)
            small, long = pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(part, small), pa.array(entry, small), pa.array(at, small), pa.array(n, long), pa.array(total, long)], ["part", "entry", "at", "n", "total"])

    cells = rows.mapInArrow(step, "part int, entry int, at int, n bigint, total bigint").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = [e.copy() for e in books.entries]
    for r in cells.collect():  # a number for each component of each entry
        entries[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return Codebooks(books.cuts, entries)


def _whole_numbers(vector: Column) -> Column:
    """floor(4096 x) of each component; null where the vector takes no part."""
    x = vector.cast("array<double>")
    most = F.floor(F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.size(x), F.lit(1))))  # whole squared distances then fit 64 bits
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < most))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * SCALE).cast("bigint")))


def product_codes(vectors: DataFrame, parts: int = 8, size: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks | None]:
    """vectors: vec_id, embedding, label. Returns (vec_id, label, code, error) and the codebooks learned.

    Rows whose vector is null or empty, or holds a null or non-finite component or one too large for 64-bit squared
    distances (32,768 and above in 64 dimensions), are dropped; so are rows of another length than that of the smallest
    kept vec_id. Codebooks begin as the parts of the ``size`` smallest vec_ids (nulls last, equal ones by vector; all
    rows, if fewer). Vectors are cut into ``parts`` equal consecutive parts, as equal as can be where the length is no
    multiple. Repeated rows count as often as they come. ``code`` has two hex digits for each part; null and repeated
    labels are kept as they are. Other columns are not read. No usable row: no result and no codebooks.
    """
    if size > 256:
        raise ValueError("two hex digits name at most 256 entries")
    numbers = vectors.select("vec_id", "label", _whole_numbers(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    numbers = written(numbers, "numbers")
    ahead = [F.col("vec_id").asc_nulls_last(), "v"]
    first = numbers.select("vec_id", "v").orderBy(*ahead).limit(1).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id {kind[0]}, label {kind[1]}, code string, error bigint"
    if not first:
        return numbers.sparkSession.createDataFrame([], schema), None
    d = len(first[0]["v"])
    rows = numbers.where(F.size("v") == d)
    seeds = rows.select("vec_id", "v").orderBy(*ahead).limit(size).collect()
    books = Codebooks.begin(np.array([r["v"] for r in seeds], np.int64), parts)
    for _ in range(rounds):
        books = _refined(rows.select("v"), books, d)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = sent.value.assign(_matrix(batch.column("v"), d))
            text = ["".join(c) for c in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(step, schema), books


def code_report(vectors: DataFrame) -> DataFrame:
    """Codes with the error of their label (nulls together) and the digest of all codebook entries.

    A label's sum is added up before the shuffle and comes back in ``SALTS`` copies, so no label's rows meet in one task.
    """
    coded, books = product_codes(vectors)
    coded = written(coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    copies = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    met = coded.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("share")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
