import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import lexical_search as ls
from docloom.llm import spans

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = Counter(terms(text)), []
        for d, bag in bags:
            m = 100 - 25 + (25 * bag.total() * n_docs) // total if total else 0
            score = sum(q * weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, q in asked.items() if bag[t])
            if score > 0:
                scored.append((-score, d is None, d, score))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string").repartition(3)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in ls.search(d, q, k).collect()), key=str)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "Über", "x-y", "it's"]
    odds = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=odds / odds.sum()))) for i in range(n)]
    return docs, [(i, " ".join(rng.choice(words, rng.integers(1, 25)))) for i in range(12)]


@pytest.mark.parametrize("sizes", [(4 << 20, 1 << 20, 256), (60, 500, 2)])
def test_equals_scoring_every_document(spark, sizes, monkeypatch):
    for name, value in zip(("SHEET_BYTES", "BLOCK_POSTINGS", "WAVE"), sizes, strict=True):
        monkeypatch.setattr(ls, name, value)
    docs, items = corpus(400)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_ties_copies_nulls_and_empty_tables(spark):
    docs = [(i, "Same words here") for i in range(200, 0, -1)] + [(7, None), (8, ""), (None, "same words here"), (5, "same words here"), (300, "other"), (301, "!?")]
    items = [(1, "same WORDS"), (1, "other"), (1, "same WORDS"), (2, None), (3, ""), (4, "absent"), (None, "here here")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, None), (2, "?")], items) == []


def test_long_texts_are_cut_between_terms():
    text = "Aa bb " * 5000 + "c" * 9000 + " é" * 300
    column = pa.RecordBatch.from_pydict({"text": ["x", text, None, "y z"]})
    got = {}
    for data, offsets, rows in ls.text_pieces(column, "text", ls._WORD, 1000):
        found = spans.runs(ls._WORD[data], offsets)
        for r, a, b in zip(rows.tolist(), found.first, found.first[1:], strict=False):
            got.setdefault(r, []).extend(data[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b], strict=True))
    assert {r: w for r, w in got.items() if w} == {0: ["x"], 1: terms(text), 3: ["y", "z"]}


def test_sparse_table_answers_every_range():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 50, 4
    pairs = sorted({(int(t), int(d)) for t, d in zip(rng.integers(0, n_terms, 120), rng.integers(0, n_docs, 120), strict=True)})
    term, doc = (np.array(x) for x in zip(*pairs, strict=True))
    block = ls.Block(doc, term, rng.integers(1, 6, len(doc)), n_docs, n_terms)
    for t in range(n_terms):
        a, b = int(block.first[t]), int(block.first[t + 1])
        for low in range(a, b):
            for high in range(low + 1, b + 1):
                assert block.strongest(np.array([low]), np.array([high]))[0] == low + block.impact[low:high].argmax()


def test_most_documents_are_never_scored(monkeypatch):
    docs, items = corpus(5000, 1)
    vocabulary = ls.Vocabulary([t.encode() for _, x in items for t in terms(x)])
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    bags = [Counter(terms(t)) for _, t in docs]
    rows = [(d, number[t.encode()], n) for d, b in enumerate(bags) for t, n in b.items() if t.encode() in number]
    doc, term, times = (np.array(x) for x in zip(*rows, strict=True))
    length = np.array([b.total() for b in bags])
    sheet = ls.Sheet([], np.array([ls.term_weight(len(docs), int(n)) for n in np.bincount(term)]), len(docs), int(length.sum()))
    block = ls.Block(doc, term, sheet.impacts(term, times, length[doc]), len(docs), len(number))
    asked, seen = np.array([number["w58".encode()], number["w0".encode()]]) if b"w58" in number and b"w0" in number else np.array([0, 1]), []
    bounded = block._bounded
    monkeypatch.setattr(block, "_bounded", lambda low, high, r: (seen.append(len(low)), bounded(low, high, r))[1])
    found, scores = block.search(asked, np.ones(2, np.int64), 5, 0)
    every = np.zeros(len(docs), np.int64)
    for t in asked:
        a, b = block.first[t], block.first[t + 1]
        every[block.doc[a:b]] += block.impact[a:b]
    want = np.lexsort((np.arange(len(docs)), -every))[:5]
    assert found.tolist() == want.tolist()
    assert scores.tolist() == every[want].tolist()
    assert sum(seen) < 0.5 * (every > 0).sum()
