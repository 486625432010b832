"""Word-piece counts by one pass of a longest-match automaton over each word; no piece is ever built.

The automaton is a trie of the vocabulary's bytes. Where a node has no child for the next byte, its failure link says
where the longest matches of its string leave off, and its popped count how many pieces they are. So greedy
longest-match-first counts come in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import spans

_WORD = spans.byte_class(bytes(c for c in range(128) if c != 32 and not 9 <= c <= 13), high=True)


@dataclass
class Automaton:
    """Node 0 is the root. Edges are (node, byte) -> child; every byte is a piece by itself, so the root has all of them."""

    edge_node: np.ndarray
    edge_byte: np.ndarray
    edge_child: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    rest: np.ndarray  # pieces in a node's string, at the end of a word
    start: int  # the node of the mark that begins a word

    @classmethod
    def build(cls, pieces: list[bytes], mark: bytes = b"") -> Automaton:
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    is_piece.append(False)
                node = children[node][b]
            is_piece[node] |= node > 0
        n = len(children)
        fail, popped, rest = [0] * n, [0] * n, [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in children[u].items():
                    if is_piece[v]:
                        fail[v], popped[v] = 0, 1
                    else:
                        z, count = fail[u], popped[u]
                        while b not in children[z]:
                            count += popped[z]
                            z = fail[z]
                        fail[v], popped[v] = children[z][b], count
                    rest[v] = popped[v] + rest[fail[v]]
                    below.append(v)
            level = below
        start = 0
        for b in mark:
            start = children[start][b]
        edges = [(u, b, v) for u, kids in enumerate(children) for b, v in kids.items()]
        node, byte, child = (np.array(x, np.int32) for x in zip(*edges, strict=True))
        return cls(node, byte, child, *(np.array(x, np.int32) for x in (fail, popped, rest)), start)

    def table(self) -> np.ndarray:
        """Child by node and byte, -1 where there is none."""
        dense = np.full((len(self.fail), 256), -1, np.int32)
        dense[self.edge_node, self.edge_byte] = self.edge_child
        return dense

    def count(self, table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each span of ``data``, all spans a byte at a time, the longest first so that those still going are a prefix."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        going = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        state = np.full(len(order), self.start, np.int32)
        count = np.zeros(len(order), np.int64)
        for i, m in enumerate(going.tolist()):
            byte = data[at[:m] + i]
            to = table[state[:m], byte]
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                here = state[stuck]
                count[stuck] += self.popped[here]
                state[stuck] = self.fail[here]
                to[stuck] = table[state[stuck], byte[stuck]]
                stuck = stuck[to[stuck] < 0]
            state[:m] = to
        count += self.rest[state]
        out = np.empty_like(count)
        out[order] = count
        return out


def sentencepiece_pieces(path: str) -> list[bytes]:
    """Ordinary pieces of a sentencepiece file, in UTF-8; words start with its mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i).encode() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


MARK = "▁".encode()


def token_counts(docs: DataFrame, pieces: list[bytes], mark: bytes = MARK) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_tokens, longest_word (pieces), a row for each input row.

    Words are runs of characters other than ASCII white space; each is matched with ``mark`` before it. Bytes that no
    piece covers count one each. Null, empty and blank texts have no words. Repeated rows and ids stay apart; other
    columns are not read. The vocabulary is a broadcast of a few MB, bounded by the tokenizer's file.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton.build(pieces, mark))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = automaton.value
        table = held.table()
        for batch in batches:
            for part in spans.slices(batch, "text"):
                data, offsets = spans.text_buffer(part.column("text"))
                words = spans.runs(_WORD[data], offsets)
                code, where = spans.number_spans(data, words)
                each = held.count(table, data, words.start[where], words.end[where])[code]
                sums = np.concatenate([[0], np.cumsum(each)])[words.first]
                most = np.zeros(len(part), np.int64)
                np.maximum.at(most, words.owner(), each)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts().astype(np.int64)), pa.array(np.diff(sums)), pa.array(most)], ["doc_id", "n_words", "n_tokens", "longest_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), "text").mapInArrow(step, f"doc_id {kind}, n_words bigint, n_tokens bigint, longest_word bigint")
