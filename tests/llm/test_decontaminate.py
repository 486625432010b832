import random
import re

from docloom.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, item in items:
            v = words(item)
            k = min(window, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1) if grams else ():
                if tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "clash") for x in docs], SCHEMA)
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in contamination(d.repartition(3), i).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "É", "ü9"]

    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(9)] + [(50, None), (51, ""), (52, "--")]
    items.append((60, items[4][1]))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (7, items[5][1])]
    docs += [(200 + i, text(20) + (items[i][1] or "").upper() + text(15)) for i in range(9)]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(6)
    item = " ".join(str(rng.randint(0, 999)) for _ in range(40))
    far = " ".join(str(rng.randint(0, 999)) for _ in range(60_000))
    docs = [(1, far + " x " + item + " y"), (2, far), (3, item), (3, item)]
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])
    assert run(spark, [], [(1, item)]) == []
    assert run(spark, docs, []) == brute(docs, [])
