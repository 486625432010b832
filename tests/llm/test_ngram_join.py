import random
import re

import pytest

from docloom.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(s), root(d)) for d, s in sets)


def run(spark, docs):
    df = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, n int, h string")
    return sorted(tuple(r) for r in ngram_join.link_components(df.repartition(3)).collect())


@pytest.mark.parametrize("hot", [4096, 2])
def test_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(hot)
    docs, line = [], " ".join(f"c{i}" for i in range(30))
    for g in range(6):
        base = [f"W{g}x{rng.randint(0, 60)}" for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"é{rng.randint(0, 9)}"
            docs.append((len(docs) * 7 % 101 + 101 * (len(docs) // 101), " ".join(words)))
    docs += [(300 + i, line + f" tail{i} " + " ".join(f"u{i}.{j}" for j in range(rng.choice([0, 3, 9, 30])))) for i in range(15)]
    docs += [(400, None), (401, ""), (402, " \n "), (403, "one two"), (404, "One  TWO"), (405, "one"), (406, docs[3][1].upper())]
    assert run(spark, docs) == brute(docs)


def test_repeats_long_text_and_empty_table(spark):
    far = " ".join(str(i * i % 9973) for i in range(50_000))
    docs = [(1, far), (2, far + " end"), (3, "a b c d e f"), (3, "a b c d e f")]
    assert run(spark, docs) == [(1, 9973 and len(shingles(far)), 1), (2, len(shingles(far + " end")), 1), (3, 2, 3), (3, 2, 3)]
    assert run(spark, []) == []


def test_a_large_group_of_a_template_forms_no_pairs(spark, monkeypatch):
    """Instances share about seven tenths of their shingles: none link, and none are paired but with the group's first."""
    template = [f"t{i}" for i in range(140)]
    docs = [(i, " ".join([f"o{i}.{j}" for j in range(28)] + template)) for i in range(3000)] + [(9000, " ".join([f"o7.{j}" for j in range(27)] + ["new", *template]))]
    tried, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: (tried.append(pairs.count()), verified(pairs, *rest))[1])
    got = run(spark, docs)
    assert {d: c for d, _, c in got if d != c} == {9000: 7}
    assert sum(tried) <= 2 * len(docs)


def test_a_large_group_of_near_copies_meets_a_few_members_not_all(spark, monkeypatch):
    """Copies with one to four changed words: about half of all pairs link, the smallest ids with hardly any other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(150), 4 if i < 20 else rng.choice([1, 1, 2, 2, 2, 3])):
            words[at] = f"x{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "SMALL", 32, raising=False)
    tried, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: (tried.append(pairs.count()), verified(pairs, *rest))[1])
    assert run(spark, docs) == brute(docs)
    assert sum(tried) <= 25 * len(docs)
