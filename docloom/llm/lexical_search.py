"""Ranked lexical search by best-first splitting of document intervals.

1. One pass over the documents keeps, for every document, its number of terms and the occurrences of the terms that any
   item asks for. Document frequencies and lengths are counted from that table.
2. Documents are indexed in blocks. A posting list of a block is in document order, and a sparse table over it answers
   in constant time which of its postings has the largest impact between any two places.
3. For an item, the answers of all its terms over an interval of documents add up to a bound on the score of every
   document inside. Intervals are taken best bound first. The one taken is split at the document that has the largest
   single impact: that document is scored in full, the two intervals beside it are bounded anew. What cannot reach the
   k-th best score is dropped with all its documents unseen.
4. A short first visit of every block yields scores that the k-th best of all documents cannot fall below; the full visit
   starts from there, so blocks return little beside the final rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import spans
from docloom.llm.shared import written

_WORD = spans.byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz", high=True)
SHEET_BYTES = 4 << 20  # terms of the items that are looked up in one pass, about; more items take more passes
BLOCK_POSTINGS = 1 << 20  # of an index in memory: 16 bytes each, and 4 for each level of its sparse table
WAVE = 256  # intervals of an item that are split in one step, at least
FIRST_VISIT = 6  # steps of the visit that only looks for a lower bound
FOUND = "item bigint, doc_id {kind}, score bigint"


# -- terms ---------------------------------------------------------------------------------------------------

def text_pieces(batch: pa.RecordBatch, column: str, member: np.ndarray, limit: int = spans.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, rows): lower-cased texts a few MB at a time; a longer one is cut where no term is, so its row comes again."""
    begin = 0
    for part in spans.slices(batch, column, limit):
        data, offsets = spans.text_buffer(part.column(column))
        data = spans.ascii_lower(data)
        rows = np.arange(begin, begin + len(part))
        begin += len(part)
        if len(data) <= 2 * limit:
            yield data, offsets, rows
            continue
        for row, a, b in zip(rows.tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
            while a < b:
                to = min(b, a + limit)
                while to < b and member[data[to]] and member[data[to - 1]]:
                    inside = np.flatnonzero(~member[data[to : to + limit]])
                    to = min(b, to + (int(inside[0]) if len(inside) else limit))
                yield data[a:to], np.array([0, to - a]), np.array([row])
                a = to


@dataclass
class Vocabulary:
    """The terms asked for, numbered in the order of their hashes."""

    terms: list[bytes]

    def __post_init__(self) -> None:
        self.terms = sorted(set(self.terms), key=lambda t: int(_hash([t])[0]))
        self.hashes = _hash(self.terms)

    def number(self, raw: bytes, hashes: np.ndarray, found: spans.Spans, first: np.ndarray) -> np.ndarray:
        """The number of each distinct word (``first``: a span of each), -1 for other words; words are compared by their bytes."""
        out = np.full(len(first), -1, np.int64)
        if not self.terms:
            return out
        h = hashes[first]
        at = np.searchsorted(self.hashes, h)
        for i in np.flatnonzero(self.hashes[np.minimum(at, len(self.terms) - 1)] == h).tolist():
            word, j = raw[found.start[first[i]] : found.end[first[i]]], int(at[i])
            while j < len(self.terms) and self.hashes[j] == h[i]:
                if self.terms[j] == word:
                    out[i] = j
                j += 1
        return out


def _hash(terms: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in terms], np.int64)
    ends = np.cumsum(sizes)
    return spans.hash_spans(np.frombuffer(b"".join(terms), np.uint8), spans.Spans(ends - sizes, ends, np.zeros(1, np.int64)))


def _terms_of(texts: list[str | None]) -> list[list[bytes]]:
    column = pa.array(texts, pa.string())
    data, offsets = spans.text_buffer(column)
    data = spans.ascii_lower(data)
    found = spans.runs(_WORD[data], offsets)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
    return [words[a:b] for a, b in zip(found.first.tolist(), found.first[1:].tolist(), strict=False)]


def count_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n (terms of the whole text), terms (numbers asked for, ascending), times; a row for each input row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # about SHEET_BYTES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        size = max(1, len(held.terms))
        for batch in batches:
            m = len(batch)
            totals, keys, times = np.zeros(m, np.int64), [], []
            for data, offsets, rows in text_pieces(batch, "text", _WORD):
                found = spans.runs(_WORD[data], offsets)
                totals[rows] += found.counts()
                hashes = spans.hash_spans(data, found)
                asked = np.flatnonzero(np.isin(hashes, held.hashes))
                some = spans.Spans(found.start[asked], found.end[asked], found.first)
                code, first = spans.number_spans(data, some)
                number = held.number(data.tobytes(), hashes[asked], some, first)[code]
                kept = number >= 0
                key, n = np.unique(rows[found.owner()[asked][kept]] * size + number[kept], return_counts=True)
                keys.append(key)
                times.append(n)
            key, where = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
            n = np.bincount(where, np.concatenate(times) if times else None, minlength=len(key)).astype(np.int64)
            ends = np.searchsorted(key, np.arange(m + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals), pa.ListArray.from_arrays(ends, pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n))], ["doc_id", "n", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, n bigint, terms array<int>, times array<bigint>")


# -- a block's index -----------------------------------------------------------------------------------------

class Block:
    """Posting lists of some documents, one after the other in one array, and the sparse table over their impacts."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.doc, self.impact = doc[order], impact[order]
        self.key = term[order] * n_docs + self.doc
        self.first = np.searchsorted(self.key, np.arange(n_terms + 1) * n_docs)
        longest = int(np.diff(self.first).max()) if n_terms else 0
        here = np.arange(len(doc), dtype=np.int32)
        self.best = [here]  # best[j][i]: the place of the largest impact among 2^j postings from i on, of equals the first
        for j in range(1, max(1, longest).bit_length()):
            half = 1 << (j - 1)
            a = self.best[-1]
            b = np.concatenate([a[half:], a[-1:].repeat(min(half, len(a)))])
            self.best.append(np.where(self.impact[b] > self.impact[a], b, a))
        self.flat = np.concatenate(self.best)
        self.floor_log = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.floor_log[i] = self.floor_log[i // 2] + 1

    def strongest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each range [low, high) of one list; any place for an empty range."""
        size = high - low
        j = self.floor_log[np.maximum(size, 1)]
        p = len(self.doc)
        a = self.flat[j * p + np.minimum(low, p - 1)]
        b = self.flat[j * p + np.clip(high - (1 << j), 0, p - 1)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best documents among those that score ``least`` or more, ties to the first documents.

        With ``steps`` the search ends early, and the scores are those of some good documents.
        """
        held = self.first[terms + 1] > self.first[terms]
        terms, repeats = terms[held], repeats[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores
        low, high, begin = self.first[terms][None], self.first[terms + 1][None], np.zeros(1, np.int64)
        bound, split = self._bounded(low, high, repeats)
        least, last = max(1, least), self.n_docs
        alive = bound >= least
        while alive.any() and (steps is None or steps > 0):
            low, high, begin, bound, split = (x[alive] for x in (low, high, begin, bound, split))
            taken = np.zeros(len(bound), bool)
            wave = max(WAVE, len(bound) // 4)
            taken[np.argpartition(-bound, wave)[:wave] if len(bound) > wave else slice(None)] = True
            now_low, now_high, doc = low[taken], high[taken], split[taken]
            wanted = terms * self.n_docs + doc[:, None]
            at = np.clip(np.searchsorted(self.key, wanted.ravel()).reshape(wanted.shape), now_low, now_high)
            inside = np.minimum(at, len(self.key) - 1)
            met = (at < now_high) & (self.key[inside] == wanted)
            docs = np.concatenate([docs, doc])
            scores = np.concatenate([scores, (np.where(met, self.impact[inside], 0) * repeats).sum(axis=1)])
            best = np.lexsort((docs, -scores))[:k]
            best = best[scores[best] >= least]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:  # a later document must score more, an earlier one as much
                least, last = int(scores[-1]), int(docs[-1])
            new_low, new_high = np.concatenate([now_low, at + met]), np.concatenate([at, now_high])
            fresh = self._bounded(new_low, new_high, repeats)
            rest = ~taken
            low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
            begin = np.concatenate([begin[rest], begin[taken], doc + 1])
            bound, split = (np.concatenate([x[rest], y]) for x, y in zip((bound, split), fresh, strict=True))
            alive = (bound > least) | ((bound == least) & (begin < last))
            if steps is not None:
                steps -= 1
        return docs, scores

    def _bounded(self, low: np.ndarray, high: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval: the sum of its terms' largest impacts, and the document with the largest single one."""
        place = self.strongest(low, high)
        most = np.where(high > low, self.impact[place], 0) * repeats
        return most.sum(axis=1), self.doc[place[np.arange(len(low)), most.argmax(axis=1)]].astype(np.int64)


# -- search over all blocks ----------------------------------------------------------------------------------

@dataclass
class Sheet:
    """Items of one pass, each with its distinct terms and how often it has them; impacts depend on the whole table's counts."""

    items: list[tuple[int, np.ndarray, np.ndarray]]
    weight: np.ndarray
    n_docs: int
    n_terms: int

    def impacts(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 75 + (25 * length * self.n_docs) // self.n_terms
        return self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m))


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(batches: Iterator[pa.RecordBatch], sheet: Sheet) -> Iterator[tuple[pa.Array, Block]]:
    """Documents of a task in blocks of about BLOCK_POSTINGS postings, in the order they come."""
    held, size = [], 0

    def close() -> tuple[pa.Array, Block]:
        table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # so that ties go to the first document
        lists = table.column("terms").combine_chunks()
        counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        doc = np.repeat(np.arange(len(table)), counts)
        term = np.asarray(lists.flatten(), np.int64)
        times = np.asarray(table.column("times").combine_chunks().flatten(), np.int64)
        length = np.asarray(table.column("n"), np.int64)[doc]
        return table.column("doc_id").combine_chunks(), Block(doc, term, sheet.impacts(term, times, length), len(table), len(sheet.weight))

    for batch in batches:
        per = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(batch):
            room = int(np.searchsorted(np.cumsum(per[at:]), BLOCK_POSTINGS - size, side="right"))
            take = max(room, 0 if held else 1)
            if take:
                held.append(batch.slice(at, take))
                size += int(per[at : at + take].sum())
                at += take
            if at < len(batch):
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _visit(counted: DataFrame, sheet: Sheet, k: int, least: dict[int, int], steps: int | None) -> DataFrame:
    sent = counted.sparkSession.sparkContext.broadcast((sheet, least))  # two numbers for each term, one for each item
    kind = counted.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = sent.value
        for ids, block in _blocks(batches, asked):
            for item, terms, repeats in asked.items:
                docs, scores = block.search(terms, repeats, k, floor.get(item, 0), steps)
                if len(docs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item)), ids.take(pa.array(docs)), pa.array(scores)], ["item", "doc_id", "score"])

    rows = counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "times")
    return rows.mapInArrow(step, FOUND.format(kind=kind))


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Returns item_id, rank (from 1), doc_id, score: each item's k best documents.

    Terms are runs of letters a-z, digits and non-ASCII characters, A-Z lower-cased, of the whole text. The score is in
    whole numbers, see ``Sheet.impacts`` and ``term_weight``; documents that score 0 are left out, equal scores are ranked
    by doc_id (nulls last). Null, empty and very long texts are texts like any other. Repeated rows of documents count
    and are ranked as documents of their own; so does each row of ``items``, also where an item_id comes again, except that
    rows that are equal are one. Empty tables and items without terms give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    numbered = written(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sheets = max(1, -(-total // SHEET_BYTES))
    found = None
    for s in range(sheets):
        rows = numbered.where(F.pmod(F.xxhash64("item"), F.lit(sheets)) == s).select("item", "text").collect()  # about SHEET_BYTES
        asked = [(r["item"], t) for r, t in zip(rows, _terms_of([r["text"] for r in rows]), strict=True) if t]
        if not asked and (found is not None or s + 1 < sheets):
            continue
        some = _search_sheet(docs, asked, k)
        found = some if found is None else found.union(some)
    ranked = found.join(numbered.select("item", "item_id"), "item")
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_sheet(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    vocabulary = Vocabulary([t for _, terms in items for t in terms])
    counted = written(count_terms(docs, vocabulary), "terms")
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 0
    df = np.zeros(len(vocabulary.terms), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the terms of the sheet
        df[r["t"]] = r["count"]
    weight = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    asked = [(item, *np.unique([number[t] for t in terms], return_counts=True)) for item, terms in items]
    sheet = Sheet(asked, weight, max(1, n_docs), max(1, n_terms))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    early = written(_visit(counted, sheet, k, {}, FIRST_VISIT), "early")
    least = {r["item"]: r["score"] for r in early.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k).select("item", "score").collect()}
    found = written(_visit(counted, sheet, k, least, None), "found")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
