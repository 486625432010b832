import itertools
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from docloom.llm.boilerplate import drop_boilerplate
from docloom.llm.packing import optimal_borders, pack
from docloom.llm.token_counts import MARK, sentencepiece_pieces, token_counts

PAGES = "doc_id long, text string, source string, host string, lines string"


def brute_lines(rows, ratio, least):
    pages = Counter(s for _, _, s in rows)
    on = Counter((s, x) for _, t, s in rows if t is not None for x in {y.strip(" \t\r") for y in t.split("\n")} if x)
    out = []
    for d, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not (on[(s, x.strip(" \t\r"))] >= least and on[(s, x.strip(" \t\r"))] > ratio * pages[s])]
        out.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_boilerplate_lines(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["Menu", " Menu\t", "", "Ä footer", f"own {i}", "rare"]) for _ in range(rng.randint(1, 6))), rng.choice(["a", "b", None])) for i in range(80)]
    rows += [(90, None, "a"), (91, "", "a"), (92, "Menu", None), (93, "Menu\r\n Menu", "a"), (93, "Menu\r\n Menu", "a"), (94, "x\n" * 20_000 + "Menu", "b"), (95, "solo", "c")]
    df = spark.createDataFrame([(*r, "h", "l") for r in rows], PAGES)
    for ratio, least in ((0.3, 3), (0.03, 5)):
        got = drop_boilerplate(df.repartition(3), ratio=ratio, least=least)
        assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == brute_lines(rows, ratio, least)
    assert set(df.columns) < set(got.columns)
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_borders_are_the_best_of_all():
    rng = random.Random(3)
    for _ in range(30):
        lengths = rng.sample(range(1, 60), rng.randint(1, 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)

        def padded(borders, lengths=lengths, counts=counts):
            return sum(c * min(b for b in borders if b >= x) for x, c in zip(lengths, counts, strict=True))

        inner = [x for x in lengths if x != max(lengths)]
        best = min(padded([*some, max(lengths)]) for m in range(k) for some in itertools.combinations(inner, m))
        got = optimal_borders(lengths, counts, k)
        assert len(got) <= k and padded(got) == best
    assert optimal_borders([], [], 4) == []


def test_batches(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 7, 8, 20, 45])))) for i in range(150)]
    rows += [(7, rows[7][1]), (200, None), (201, " \n\t "), (202, "w " * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, n int").repartition(5)
    got = pack(df, max_tokens=20, buckets=3, budget=64).collect()
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == {d: sum(len((t or "").split()) for e, t in rows if e == d) for d, _ in rows}
    full = [r for r in got if r.bucket is not None]
    assert all(r.n_tokens == 0 for r in got if r.bucket is None)
    borders = sorted({r.bucket for r in full})
    assert borders == optimal_borders(*map(list, zip(*Counter(r.n_tokens for r in full).items(), strict=True)), 3)
    assert all(r.bucket == min(b for b in borders if b >= r.n_tokens) for r in full)
    for b in borders:
        room = max(1, 64 // b)
        order = sorted((r.batch * room + r.slot, r.doc_id, r.piece) for r in full if r.bucket == b)
        assert [x[0] for x in order] == list(range(len(order)))
        assert [x[1:] for x in order] == sorted(x[1:] for x in order)
    assert pack(df.limit(0)).count() == 0


def greedy(word, vocab, longest):
    n = 0
    while word:
        k = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocab), 1)
        word, n = word[k:], n + 1
    return n


@pytest.mark.parametrize("small", [True, False])
def test_token_counts_equal_greedy_matching(spark, small):
    rng = random.Random(8)
    if small:
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))).encode() for _ in range(12)] + [b"_abab", b"_ba", "éa".encode()]
        mark, texts = b"_", ["".join(rng.choice("ababé c \n") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    else:
        pieces, mark = sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")), MARK
        texts = ["Hello, wonderful wörld! 日本語の本 🙂", "internationalisation " * 3, "\x00\x01 a\tb"]
    texts += [None, "", " \n", "ab" * 20_000, "same", "same"]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    vocab, longest = set(pieces), max(map(len, pieces))
    want = []
    for i, t, _ in rows:
        words = [w.encode() for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        n = [greedy(mark + w, vocab, longest) for w in words]
        want.append((i, len(words), sum(n), max(n, default=0)))
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words int").repartition(3)
    assert sorted(tuple(r) for r in token_counts(df, pieces, mark).collect()) == want
    assert token_counts(df.limit(0), pieces, mark).count() == 0
