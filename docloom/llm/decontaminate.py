"""Benchmark passages in documents, found by winnowing fingerprints.

Of every ``window - gram + 1`` consecutive grams of words the one with the smallest hash is kept (the last of equals),
on both sides. Two texts that share ``window`` consecutive words share such a run of grams, hence a kept one: no shared
span of that length is missed. Kept grams are joined, and each meeting is extended word by word to the left and right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import spans
from docloom.llm.shared import written

GRAM = 5
FILTER_BITS = 22  # the broadcast filter has 2^22 cells at most, whatever the benchmark holds
_WORD = spans.byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz", high=True)

PRINTS = "array<struct<print:bigint,at:int,core:array<bigint>,left:array<bigint>,right:array<bigint>>>"
_LONGS = pa.list_(pa.int64())
_PRINT = pa.struct([("print", pa.int64()), ("at", pa.int32()), ("core", _LONGS), ("left", _LONGS), ("right", _LONGS)])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, runs of a-z, 0-9 and non-ASCII characters), and each text's word range."""
    data, offsets = spans.text_buffer(column)
    data = spans.ascii_lower(data)
    found = spans.runs(_WORD[data], offsets)
    return spans.hash_spans(data, found), found.first


def winnow(grams: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of every ``width`` consecutive grams of one text (of all, if a text has fewer)."""
    counts = np.diff(bounds)
    windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = spans.ragged(bounds[:-1], windows)
    last = np.repeat(bounds[1:], windows) - 1
    best, place = grams[at], at.copy()
    for i in range(1, width):
        here = np.minimum(at + i, last)
        less = grams[here] <= best
        best = np.where(less, grams[here], best)
        place = np.where(less, here, place)
    return np.unique(place)


def _padded(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, steps: range) -> list[np.ndarray]:
    places = [at + s for s in steps]
    return [np.where((p >= low) & (p < high), words[np.clip(p, 0, len(words) - 1)], 0).astype(np.int64) for p in places]


def _prints(words: np.ndarray, first: np.ndarray, window: int, shorts: list[int], seen: np.ndarray | None, whole: bool) -> tuple[pa.Array, ...]:
    """The kept grams of each text with the words around them. ``shorts``: lengths of texts that are one short window.

    ``whole``: the texts are benchmark items, so a text shorter than the window gives its whole sequence only.
    """
    counts = np.diff(first)
    owner, at, size, value = [], [], [], []

    def keep(place: np.ndarray, bounds: np.ndarray, grams: np.ndarray, k: int, rows: np.ndarray) -> None:
        doc = np.searchsorted(bounds, place, side="right") - 1
        h = spans.mix(grams[place] + np.uint64(k))
        ok = rows[doc] if seen is None else rows[doc] & seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)]
        owner.append(doc[ok])
        at.append((place - bounds[doc])[ok])
        size.append(np.full(int(ok.sum()), k))
        value.append(h[ok])

    grams, bounds = spans.hash_grams(words, first, GRAM)
    keep(winnow(grams, bounds, window - GRAM + 1), bounds, grams, GRAM, counts >= window)
    for k in shorts:  # not thinned out: a short window must be met wherever it stands
        grams, bounds = spans.hash_grams(words, first, k)
        keep(np.arange(len(grams)), bounds, grams, k + 100, counts == k if whole else counts >= k)
    owner, at, size, value = (np.concatenate(x) for x in (owner, at, size, value))
    order = np.argsort(owner, kind="stable")
    owner, at, size, value = owner[order], at[order], size[order], value[order]
    here, low, high = first[owner] + at, first[owner], first[owner + 1]
    long = size == GRAM
    k = np.where(long, GRAM, size - 100)
    reach = window - GRAM
    n = len(owner)

    def lists(columns: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
        table = np.stack(columns, axis=1) if columns else np.zeros((n, 0), np.int64)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(table[np.arange(table.shape[1]) < lengths[:, None]]))

    core = lists(_padded(words, here, low, high, range(max([GRAM, *shorts]))) if n else [], k if n else np.zeros(0, int))
    side = np.where(long, reach, 0)
    left = lists(_padded(words, here, low, high, range(-1, -reach - 1, -1)) if n else [], side)
    right = lists(_padded(words, here + k, low, high, range(reach)) if n else [], side)
    items = pa.StructArray.from_arrays([pa.array(value.astype(np.int64)), pa.array(at, pa.int32()), core, left, right], fields=list(_PRINT))
    per = np.bincount(owner, minlength=len(counts))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per)]).astype(np.int32), items), pa.array(counts, pa.int64())


def _printed(texts: DataFrame, keys: str, window: int, shorts: list[int], seen: np.ndarray | None, whole: bool) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                prints, counts = _prints(*words_of(part.column("text")), window, shorts, seen, whole)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts, prints], [*part.schema.names[:2], "n_words", "prints"])

    return texts.mapInArrow(step, f"{keys}, n_words bigint, prints {PRINTS}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents against benchmark items: doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. A window is ``window`` consecutive words of
    an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is
    hit. One row for each input row, repeated ids included; null and empty texts have no words and no hits. An empty
    benchmark hits nothing. Items that are equal are all reported.
    """
    reach = window - GRAM
    items = benchmark.select(F.col("item_id").cast("string"), F.monotonically_increasing_id().alias("item"), "text").select("item_id", "item", "text")
    lengths = written(_printed(items, "item_id string, item bigint", window, list(range(1, window)), None, True), "items")
    shorts = sorted(r.n_words for r in lengths.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect())
    item_prints = lengths.select("item_id", F.explode("prints").alias("i"))
    cells = item_prints.select(F.col("i.print").bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("cell")).distinct().toArrow()["cell"].to_numpy()
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[cells] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))  # 512 KB

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            for part in spans.slices(batch, "text"):
                prints, counts = _prints(*words_of(part.column("text")), window, shorts, held, False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts, prints], ["doc_id", "row", "n_words", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    printed = written(texts.mapInArrow(step, f"doc_id {kind}, row bigint, n_words bigint, prints {PRINTS}"), "prints")

    met = printed.select("row", F.explode("prints").alias("d")).withColumn("print", F.col("d.print")).join(
        item_prints.withColumn("print", F.col("i.print")), "print")

    def run(side: str) -> F.Column:
        same = F.zip_with(f"d.{side}", f"i.{side}", lambda a, b: (a == b) & (a != 0))
        miss = F.array_position(same, F.lit(False)).cast("int")
        return F.when(miss == 0, F.size(same)).otherwise(miss - 1)

    k = F.size("d.core")
    spanned = (met.where("d.core = i.core").withColumn("l", run("left")).withColumn("r", run("right"))
               .where((F.size("d.left") == 0) | (F.col("l") + F.col("r") + k >= window))
               .select("row", "item_id", F.struct((F.col("d.at") - F.col("l")).alias("a"), (F.col("d.at") + k + F.col("r")).alias("b")).alias("span")))
    per = spanned.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")),
        lambda s: s["n"].cast("long"))
    assert reach >= 0
    hits = per.select("row", covered.alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    return printed.select("row", "doc_id", "n_words").join(hits, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The result with its item list as a count and a checksum."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
