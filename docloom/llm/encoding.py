"""Token ids of a byte-level BPE vocabulary, each distinct word of a worker encoded once."""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from docloom.llm import spans

# Space as the byte-level pre-tokenizer sees it: these bytes, and the characters below (they send a text to the plain path).
_SPACE = spans.byte_class(b"\t\n\x0b\x0c\r ", high=False)
_RARE_LEAD = spans.byte_class(b"\x1c\x1d\x1e\x1f", high=False)
_RARE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = spans.byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=False)
_MARK = spans.byte_class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", high=False)
_RARE = frozenset("\x1c\x1d\x1e\x1f\x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}

CACHE_ENTRIES = 1_000_000  # distinct chunks a worker remembers before it starts afresh (about 100 MB)
JOINED = 4096


class ChunkEncoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False)``.

    The pre-tokenizer never joins a non-space with a following space, and of a run of spaces only a last plain space
    goes with the next word; nor does it join a letter with a following ASCII mark. So a text is the sequence of its
    chunks (a word with at most one space before it, the marks after it, or a run of other spaces) and its ids are those
    of the chunks in turn. Chunks are found and numbered for a whole batch and known by their bytes; only unseen ones go
    through the tokenizer, many in one call, separated by line breaks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self._plain("\n")
        self._clear()

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, keys: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keys with the number of their ids, and all these ids one after the other."""
        n = len(self.known)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(keys) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.size[n : n + len(keys)] = lengths
        self.used += len(ids)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _learn(self, keys: list[bytes]) -> None:
        chunks = [k.decode() for k in keys]
        words = [i for i, c in enumerate(chunks) if not c.isspace()]
        alone = [i for i, c in enumerate(chunks) if c.isspace()]
        for lo in range(0, len(words), JOINED):
            some = words[lo : lo + JOINED]
            joined = self._plain("\n".join([chunks[i] for i in some]))
            breaks = np.flatnonzero(joined == self.line[0])
            if len(breaks) == len(some) - 1:
                self._add([keys[i] for i in some], np.delete(joined, breaks), np.diff(np.concatenate([[-1], breaks, [len(joined)]])) - 1)
            else:
                alone += some
        for i in alone:
            ids = self._plain(chunks[i])
            self._add([keys[i]], ids, np.array([len(ids)]))

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> spans.Spans:
        n = len(data)
        space = _SPACE[data]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        after = np.ones(n, bool)  # the next byte of the text is a space, or there is none
        after[:-1] = space[1:]
        after |= border[1:]
        last = space & ~after
        begins = border[:n].copy()  # a text, a space after a word, the last of several spaces, a word after another space
        begins[1:] |= space[1:] & ~space[:-1]
        begins |= last
        begins[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
        begins[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        return spans.Spans(start, end, np.searchsorted(start, offsets))

    def _rare(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Documents with a space character the chunk rule does not know, or with the string of a special token."""
        at = np.flatnonzero(_RARE_LEAD[data])
        lead = data[at]
        second = data[np.minimum(at + 1, len(data) - 1)]
        maybe = at[(lead < 32) | ((lead == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((lead == 0xE1) & (second == 0x9A)) | ((lead == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((lead == 0xE3) & (second == 0x80))]
        docs = np.unique(np.searchsorted(offsets, maybe, side="right") - 1)
        odd = {d for d in docs.tolist() if not _RARE.isdisjoint(data[offsets[d] : offsets[d + 1]].tobytes().decode())}
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        return np.array(sorted(odd), np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text's ids. Nulls are empty texts."""
        data, offsets = spans.text_buffer(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        raw = data.tobytes()
        found = self._chunks(data, offsets)
        code, first = spans.number_spans(data, found)
        if len(self.known) + len(first) > CACHE_ENTRIES:
            self._clear()
        keys = [raw[a:b] for a, b in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)]
        row = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(row < 0)
        if len(new):
            unseen = [keys[i] for i in new.tolist()]
            self._learn(unseen)
            row[new] = np.fromiter(map(self.known.__getitem__, unseen), np.int64, len(unseen))
        row = row[code]
        sizes = self.size[row]
        ids = self.pool[spans.ragged(self.at[row], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[found.first]
        odd = self._rare(data, raw, offsets)
        if len(odd):
            parts = {d: self._plain(data[offsets[d] : offsets[d + 1]].tobytes().decode()) for d in odd.tolist()}
            each = [parts.get(d, ids[bounds[d] : bounds[d + 1]]) for d in range(n)]
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds


_held: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file: loaded once, and its chunks are remembered from task to task."""
    if path not in _held:
        _held[path] = ChunkEncoder(path)
    return _held[path]
