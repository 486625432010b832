"""Linear-chain conditional random field over word labels: batched exact inference and training, in numpy.

Scores of a label sequence: one weight for each (feature of the word, label) and one for each pair of neighbouring labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from docloom.llm import spans

BUCKETS = 1 << 17  # of hashed affixes and n-grams
BLOCK = 256  # words a long text is cut into for inference; the result does not depend on it
_LETTER = spans.byte_class(b"abcdefghijklmnopqrstuvwxyz", high=True)


def letters(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the two-byte capitals from A with grave to Thorn."""
    data = spans.ascii_lower(data)
    if len(data) > 1:
        after = data[1:]
        capital = (data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        data[1:][capital] |= 0x20
    return data


@dataclass
class Words:
    """Distinct words of a batch with their features, and the batch's texts as sequences of them."""

    code: np.ndarray  # distinct word of each word
    first: np.ndarray  # word range of each text
    hashes: np.ndarray  # of the distinct words
    feature: np.ndarray  # bucket of each feature, distinct word after distinct word
    at: np.ndarray  # feature range of each distinct word


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of letters and non-ASCII bytes; their features are all 2-, 3- and 4-grams of bytes between two
    edge marks, so that those with a mark are the prefixes and suffixes of 1 to 3 bytes."""
    data = letters(data)
    found = spans.runs(_LETTER[data], offsets)
    code, hashes = pd.factorize(spans.hash_spans(data, found)) if len(found.start) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    where = np.zeros(len(hashes), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    start, size = found.start[where], (found.end - found.start)[where]
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.full(begin[-1], 2, np.uint64)  # end marks
    text[begin[:-1]] = 1
    text[spans.ragged(begin[:-1] + 1, size)] = data[spans.ragged(start, size)]
    features, owners = [], []
    word = np.repeat(np.arange(len(size)), size + 2)
    for n in (2, 3, 4):
        if len(text) < n:
            continue
        h = np.full(len(text) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + text[i : i + len(h)]
        inside = word[: len(h)] == word[n - 1 :]
        features.append((spans.mix(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(word[: len(h)][inside])
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    feature = np.concatenate(features)[order] if features else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])
    return Words(code, found.first, hashes, feature, at)


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # BUCKETS x labels
    lexicon: np.ndarray  # sorted hashes of the words it knows
    known: np.ndarray  # lexicon words + 1 x labels; the last row is for all others
    change: np.ndarray  # labels x labels

    def rows(self, words: Words) -> np.ndarray:
        """Lexicon row of each distinct word."""
        if not len(self.lexicon):
            return np.zeros(len(words.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, words.hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == words.hashes, at, len(self.lexicon))

    def scores(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """Score of each distinct word for each label."""
        if not len(rows):
            return np.zeros((0, len(self.labels)))
        return np.add.reduceat(self.grams[words.feature], words.at[:-1], axis=0) + self.known[rows]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(score: np.ndarray, first: np.ndarray, change: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word given its whole text, and expected label changes summed over all texts.

    Forward-backward for all texts at once. A text is cut into blocks; the product of a block's transfer matrices carries
    the message across it, so messages pass from block to block first and then inside all blocks in step.
    """
    n, k = score.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    e = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-12
    a = np.exp(change - change.max())
    counts = np.diff(first)
    per = -(-counts // block)
    bounds = np.concatenate([[0], np.cumsum(per)])
    start = np.repeat(first[:-1], per) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)) * block
    size = np.minimum(block, np.repeat(first[1:], per) - start)
    order = np.argsort(-size, kind="stable")
    place = np.argsort(order, kind="stable")  # block -> its row in the arrays below
    start, size = start[order], size[order]
    going = np.searchsorted(-size, -np.arange(int(size[0])), side="left").tolist()

    across = np.repeat(np.eye(k)[None], len(size), axis=0)
    for t, m in enumerate(going):
        x = (across[:m].reshape(-1, k) @ a).reshape(m, k, k) * e[start[:m] + t][:, None, :]
        across[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    into = np.full((len(size), k), 1 / k)
    out = np.full((len(size), k), 1 / k)
    docs = np.argsort(-per, kind="stable")
    for t in range(1, int(per.max())):
        here = bounds[docs[: np.searchsorted(-per[docs], -t, side="left")]] + t
        into[place[here]] = _unit(np.einsum("bi,bij->bj", into[place[here - 1]], across[place[here - 1]]))
    for t in range(int(per.max()) - 2, -1, -1):
        here = bounds[docs[: np.searchsorted(-per[docs], -(t + 1), side="left")]] + t
        out[place[here]] = _unit(np.einsum("bij,bj->bi", across[place[here + 1]], out[place[here + 1]]))
    ahead = np.empty((n, k))
    state = into.copy()
    for t, m in enumerate(going):
        state[:m] = _unit((state[:m] @ a) * e[start[:m] + t])
        ahead[start[:m] + t] = state[:m]
    result = np.empty((n, k))
    changes = np.zeros((k, k))
    back = out.copy()
    for t in range(len(going) - 1, -1, -1):
        m = going[t]
        at = start[:m] + t
        result[at] = _unit(ahead[at] * back[:m])
        weighted = e[at] * back[:m]
        before = ahead[at - 1] if t else into[:m]
        pair = before[:, :, None] * a * weighted[:, None, :]
        total = pair.sum(axis=(1, 2), keepdims=True)
        inner = np.ones(m, bool) if t else ~np.isin(at, first[:-1])
        changes += (pair / total)[inner].sum(axis=0)
        back[:m] = _unit(weighted @ a.T)
    return result, changes


def train(texts: list[str], labels: list[str], *, seed: int = 1, run: int = 24, least: int = 3, rounds: int = 25, rate: float = 0.4, decay: float = 1e-4) -> Model | None:
    """Fit on labelled texts. Texts of one language are cut into runs of up to ``run`` words, which are shuffled and strung
    together to code-switched sequences with a label for each word; so label changes are learned too.

    The lexicon are the words seen ``least`` times. Full gradients, with step sizes by past gradients of each weight.
    """
    names = sorted(set(labels))
    raw = [t.encode() for t in texts]
    words = words_of(np.frombuffer(b"".join(raw), np.uint8).copy(), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    if not names or not len(words.code):
        return None
    rng = np.random.default_rng(seed)
    k, pieces = len(names), []
    for a, b, y in zip(words.first.tolist(), words.first[1:].tolist(), labels, strict=False):
        while a < b:
            to = min(b, a + int(rng.integers(run // 4, run + 1)))
            pieces.append((a, to, names.index(y)))
            a = to
    rng.shuffle(pieces)
    lengths = np.array([b - a for a, b, _ in pieces])
    take = spans.ragged(np.array([a for a, _, _ in pieces]), lengths)
    code, truth = words.code[take], np.repeat([y for _, _, y in pieces], lengths)
    first = np.append(np.arange(0, len(code), 5 * run), len(code))
    seen = np.bincount(code, minlength=len(words.hashes))
    lexicon = np.sort(words.hashes[seen >= least])
    model = Model(names, np.zeros((BUCKETS, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)))
    rows = model.rows(words)
    real = np.zeros((k, k))
    inner = np.ones(len(code), bool)
    inner[first[:-1]] = False
    np.add.at(real, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    owner = np.repeat(np.arange(len(words.hashes)), np.diff(words.at))
    past = [np.full_like(w, 1e-8) for w in (model.grams, model.known, model.change)]
    for _ in range(rounds):
        p, changes = posteriors(model.scores(words, rows)[code], first, model.change)
        p[np.arange(len(code)), truth] -= 1
        by_word = np.stack([np.bincount(code, weights=p[:, y], minlength=len(words.hashes)) for y in range(k)], axis=1)
        grams = np.stack([np.bincount(words.feature, weights=by_word[owner, y], minlength=BUCKETS) for y in range(k)], axis=1)
        known = np.stack([np.bincount(rows, weights=by_word[:, y], minlength=len(model.known)) for y in range(k)], axis=1)
        for w, g, s in zip((model.grams, model.known, model.change), (grams, known, changes - real), past, strict=True):
            g = g / len(code) + decay * w
            s += g * g
            w -= rate * g / np.sqrt(s)
    return model
