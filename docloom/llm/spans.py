"""Words of Arrow text columns as byte spans and 64-bit hashes, a whole batch at a time.

All offsets are byte offsets into the UTF-8 data of the batch. Spans never cross a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20  # working memory of a step, about 60 times this; a longer text is one slice of its own

_ODD = np.uint64(0xD6E8FEB86659FD93)
SHORT = 64  # bytes; longer spans are hashed one by one
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # mask of the first i bytes of a block


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (SplitMix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BY_SIZE = mix(np.arange(SHORT + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def byte_class(chars: bytes, *, high: bool) -> np.ndarray:
    """Membership table of 256 bytes; ``high``: bytes of 128 and more belong to it."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    table[128:] = high
    return table


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets; a null is an empty text."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if column.null_count:  # bytes below a null are not part of any text
        sizes = np.diff(offsets)
        kept = np.asarray(column.is_valid())
        data = data[np.repeat(kept, sizes)]
        offsets = np.concatenate([[0], np.cumsum(np.where(kept, sizes, 0))])
    return data, offsets


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, whole rows each."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Spans:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of n + 1 entries: first[d] is the first span of document d

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def runs(member: np.ndarray, offsets: np.ndarray) -> Spans:
    """Longest runs of bytes that are members, cut at document borders."""
    n = len(member)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = member[:-1]
    start = np.flatnonzero(member & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = member[1:]
    end = np.flatnonzero(member & (~after | border[1:])) + 1
    return Spans(start, end, np.searchsorted(start, offsets))


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one little-endian number; zeros stand after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, spans: Spans) -> np.ndarray:
    """Hash of each span's bytes, the same wherever they stand: length and eight-byte blocks mixed in one after the other.

    Each step is one-to-one in its block, so texts that differ in one block never meet and others only by chance.
    """
    size = spans.end - spans.start
    blocks = _blocks(data)
    h = mix((_BY_SIZE[np.minimum(size, SHORT)] ^ (blocks[spans.start] & _TAIL[np.minimum(size, 8)])) * _ODD)
    going = np.flatnonzero((size > 8) & (size <= SHORT))
    at, left = spans.start[going] + 8, size[going] - 8
    while len(going):
        h[going] = mix((h[going] ^ (blocks[at] & _TAIL[np.minimum(left, 8)])) * _ODD)
        more = left > 8
        going, at, left = going[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[spans.start[i] : spans.end[i]].tobytes())
    return h


def number_spans(data: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal for equal bytes and only for them, and the first span of each number.

    Spans are grouped by hash; every one is then compared with the first of its group, byte by byte.
    """
    code, distinct = pd.factorize(hash_spans(data, spans))
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    size, blocks = spans.end - spans.start, _blocks(data)
    like = first[code]
    same = size == size[like]
    going = np.flatnonzero(same & (size <= SHORT) & (like != np.arange(len(code))))
    at, to, left = spans.start[going], spans.start[like[going]], size[going]
    while len(going):
        mask = _TAIL[np.minimum(left, 8)]
        same[going] &= (blocks[at] & mask) == (blocks[to] & mask)
        more = left > 8
        going, at, to, left = going[more], at[more] + 8, to[more] + 8, left[more] - 8
    for i in np.flatnonzero(same & (size > SHORT)).tolist():
        j = like[i]
        same[i] = i == j or np.array_equal(data[spans.start[i] : spans.end[i]], data[spans.start[j] : spans.end[j]])
    if not same.all():  # two texts of one hash: number by the bytes themselves
        raw = data.tobytes()
        code, _ = pd.factorize(np.array([raw[a:b] for a, b in zip(spans.start.tolist(), spans.end.tolist(), strict=True)], object))
        first = np.zeros(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def hash_grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and the gram range of each document.

    A document of fewer than k words, but not none, has one gram: its whole sequence.
    """
    counts = np.diff(first)
    grams = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(grams)])
    at = np.repeat(first[:-1] - bounds[:-1], grams) + np.arange(bounds[-1])
    span = np.repeat(np.minimum(counts, k), grams)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = i < span
        step = mix(h * np.uint64(31) + words[np.minimum(at + i, len(words) - 1)] + np.uint64(i)) if len(words) else h
        h = np.where(inside, step, h)
    return h, bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] … starts[i] + lengths[i] - 1 for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
