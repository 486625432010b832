"""Splitting and packing text inside a row: every function maps a text column to array<string>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .text import let

# Section heads looked for before packing, in this order.
HEADER_PATTERNS = (
    r"\n(?=\s*(?:SECTION|Article|ARTICLE|Chapter|CHAPTER)\s+\d+[:\.])",
    r"\n(?=\s*\d+\.\s+[A-Z])",
    r"\n(?=\s*[A-Z][A-Z\s]+(?:\n|$))",
)

# Section marks for very long sections, in this order.
SECTION_MARKS = (
    r"(?=\n\s*Article\s+\d+\s*\n)", r"(?=\n\s*Section\s+\d+\s*\n)", r"(?=\n\s*CHAPTER\s+\d+\s*\n)",
    r"(?=\n\s*TITLE\s+\d+\s*\n)", r"(?=\n\s*\d+\.\s+)", r"(?=\n\n)",
)
CHUNK_WORDS, PACK_WORDS = 514, 1000
WEIGHTS_BY_POSITION, LATER_WEIGHT = (1.2, 1.0, 0.8, 0.6, 0.5), 0.5
SHARES_BY_CHUNK, LATER_SHARE = (0.34, 0.30, 0.245, 0.20, 0.165), 0.125

EMPTY = "array<string>"


def _number(n: int | Column) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def pack(pieces: Column, separator: str, limit: int | Column, at_least: int | Column = 0) -> Column:
    """Join neighbouring pieces greedily up to ``limit`` words; a longer piece stands alone.

    With ``at_least``, a chunk is only closed once it holds that many words. The fold keeps chunk start positions, not text.
    """
    limit, at_least = _number(limit), _number(at_least)
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("i"))

    def step(acc: Column, w: Column) -> Column:
        fresh = (acc["i"] == 1) | ((acc["n"] + w > limit) & (acc["n"] >= at_least))
        return F.struct(
            F.when(fresh, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(fresh, w).otherwise(acc["n"] + w).alias("n"),
            (acc["i"] + 1).alias("i"),
        )

    def cut(p: Column) -> Column:
        starts = F.aggregate(F.transform(p, tx.word_count), start, step, lambda acc: acc["starts"])
        return let(starts, lambda s: F.zip_with(
            s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(p) + 1)),
            lambda a, b: F.array_join(F.slice(p, a, b - a), separator),
        ))

    return F.when(F.size(pieces) > 0, let(pieces, cut)).otherwise(F.array().cast(EMPTY))


def _blankless(parts: Column) -> Column:
    return F.filter(F.transform(parts, tx.strip), lambda s: s != "")


def _refine(pieces: Column, limit: int | Column, splitter: Callable[[Column], Column]) -> Column:
    """Split only the pieces over the limit."""
    return F.flatten(F.transform(
        pieces, lambda p: F.when(tx.word_count(p) > _number(limit), splitter(p)).otherwise(F.array(p))))


def by_words(text: Column, limit: int | Column) -> Column:
    limit = _number(limit)
    return let(tx.words(text), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), limit), lambda i: F.array_join(F.slice(w, i, limit), " ")))


def chunk(text: Column, limit: int | Column = CHUNK_WORDS) -> Column:
    """Chunks of at most ``limit`` words along the text's structure.

    Section heads first (head kept with its section), then paragraphs packed together, then sentences packed
    together, then plain words. A level is only applied to pieces still too long.
    """
    out = F.array(text)
    for pattern in HEADER_PATTERNS:
        out = _refine(out, limit, lambda p, r=pattern: _blankless(F.split(p, r)))
    out = _refine(out, limit, lambda p: pack(_blankless(F.split(p, r"\n\s*\n")), "\n\n", limit))
    out = _refine(out, limit, lambda p: pack(tx.sentences(p), " ", limit))
    out = _refine(out, limit, lambda p: by_words(p, limit))
    none = F.array().cast(EMPTY)
    # Most texts fit into one chunk: they skip the cascade.
    return let(tx.word_count(text), lambda n: F.when(n == 0, none).when(n <= _number(limit), F.array(text)).otherwise(out))


def sentence_chunks(text: Column, limit: int | Column = PACK_WORDS) -> Column:
    return pack(tx.sentences(text), " ", limit)


def subsections(text: Column, low: int = 750, high: int = 1500) -> Column:
    """Whole text up to ``high`` words, else sentence-bounded parts that close above ``low`` words."""
    return F.when(tx.word_count(text) <= high, F.array(text)).otherwise(pack(tx.sentences(text), " ", high, low))


def long_sections(text: Column, limit: int = 3000) -> Column:
    """Split before section marks, mark by mark, while a part holds over ``limit`` words."""
    out = F.array(text)
    for mark in SECTION_MARKS:
        out = _refine(out, limit, lambda p, r=mark: _blankless(F.split(p, r)))
    return out


def chunk_again(part: Column, largest: int = 350) -> Column:
    """A part of a long section, split to at most ``largest`` words: sentences packed, then plain words."""
    n = tx.word_count(part)
    limit = F.least(tx.balanced_chunk_size(n), F.lit(largest))
    split = let(limit, lambda m: _refine(pack(tx.sentences(part), " ", m), m, lambda p: by_words(p, m)))
    return F.when(n > largest, split).otherwise(F.array(part))


def middle_weights(n: Column) -> Column:
    """Position weights 1.5 - x^2 for n chunks, x even on -1..1, scaled so that they sum to n."""
    x = lambda i: F.lit(-1.0) + F.lit(2.0) * i / (n - 1)
    raw = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.lit(1.5) - x(i) * x(i))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda s, v: s + v)
    return F.when(n <= 1, F.array(F.lit(1.0))).otherwise(
        let(raw, lambda w: let(total(w), lambda t: F.transform(w, lambda v: v * n / t))))


def position_weight(i: Column) -> Column:
    """Weight of the i-th (from 0) chunk of a document."""
    return F.coalesce(F.get(F.array(*(F.lit(w) for w in WEIGHTS_BY_POSITION)), i), F.lit(LATER_WEIGHT))


def chunk_share(i: Column) -> Column:
    """Share extracted from the i-th (from 0) chunk of a document."""
    return F.coalesce(F.get(F.array(*(F.lit(w) for w in SHARES_BY_CHUNK)), i), F.lit(LATER_SHARE))
