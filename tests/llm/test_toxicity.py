import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import toxicity as tx
from docloom.llm.language_id import held_out


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["ba", "lo", "ki", "ma", "ter", "ung"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "Grumsel", "grumselig", "grumselor", "vexnor"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_votes_of_single_texts():
    held = tx.voters([("word", b"vexnor"), ("prefix", b"grum")])
    texts = ["you idiot", "idiot you", "STOP THAT SHOUTING NOW PLEASE", "hm!!!", "hm!!", "!", "!!", "Vexnor grumsel grum", "grumA grumB", None, "", "idiot moron", "tú imbécil"]
    fired = tx.votes(pa.array(texts), held)
    got = [{held.names[v] for v in np.flatnonzero(row)} for row in fired]
    second, twice = tx.PATTERNS[1], tx.PATTERNS[0]
    assert got[0] == {"lexicon en", second} and got[1] == {"lexicon en"} and got[11] == {"lexicon en", twice}
    assert got[2] == {tx.PATTERNS[2]} and got[3] == {tx.PATTERNS[3]} and not got[4] and not got[5] and not got[6]
    assert got[7] == {"word vexnor 1", "prefix grum 1"} and got[8] == {"prefix grum 1", "prefix grum 2"}
    assert not got[9] and not got[10] and got[12] == {"lexicon es", second}


def test_held_out_rows(spark):
    rows = corpus(900, 1)
    odd = [(5000, None), (5001, ""), (5002, "vexnor " + "balo " * 40_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(d, t, 0.1, 1) for d, t, _ in rows] + [(*o, 0.2, 0) for o in odd], "doc_id long, text string, score double, toxic int").repartition(4)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(7, None), (99999, 1), (8, 5)], "doc_id long, toxic int")
    held = held_out(4, 2)
    got = tx.toxicity(docs, labels, ~held).withColumn("held", held).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {d: y for d, _, y in rows}
    test = [r for r in got if r.held and r.doc_id in truth]
    assert sum((r.score >= 0.3) == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    one = {r.doc_id: r for r in got}
    assert one[5000].n_votes == one[5001].n_votes == 0 and one[5000].score < 0.1 and one[5002].score >= 0.3


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(i, "you stupid idiot" if i % 9 == 0 else "good day") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in tx.toxicity(docs, labels, F.lit(True)).collect()}
    assert got[0] > 0.5 > got[1]
    assert tx.toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_a_repeated_voter_counts_less(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(3000):
        y = rng.random() < 0.2
        a = rng.random() < (0.6 if y else 0.02)
        b = rng.random() < (0.6 if y else 0.02)
        rows.append(([0] * a + [1] * a + [2] * b, None, 1))
    patterns = spark.createDataFrame(rows, "votes array<int>, toxic int, n long").groupBy("votes", "toxic").agg(F.sum("n").alias("n"))
    weight = tx.fit_labels(patterns, 10).weight
    assert weight[0] < 0.7 and weight[1] < 0.7 and weight[2] > 0.8


def plain_model(rows, m, rounds, again):
    """The label model and the classifier row by row, in plain loops."""
    prior, lists = 0.1, len(tx.LEXICONS)
    rate = [[0.002] * m, [0.2] * m]
    for v in (lists + 2, lists + 3):
        rate[0][v], rate[1][v] = 0.05, 0.1
    labelled, weight = [0.01, 0.99], [1.0] * m

    def posterior(votes, label):
        odds = math.log(prior / (1 - prior))
        for v in range(m):
            a, b = (rate[1][v], rate[0][v]) if v in votes else (1 - rate[1][v], 1 - rate[0][v])
            odds += weight[v] * math.log(a / b)
        if label is not None:
            odds += math.log(labelled[1] / labelled[0]) if label else math.log((1 - labelled[1]) / (1 - labelled[0]))
        return 1 / (1 + math.exp(-max(-40, min(40, odds))))

    def round_():
        nonlocal prior, rate, labelled
        q = [posterior(*r) for r in rows]
        mass = [sum(1 - x for x in q), sum(q)]
        new, said = [], []
        for y in (0, 1):
            w = [x if y else 1 - x for x in q]
            new.append([min(1 - 1e-5, max(1e-5, (sum(x for x, (votes, _) in zip(w, rows) if v in votes) + (0.05, 0.5)[y] * 2) / (mass[y] + 10))) for v in range(m)])
            yes, no = (sum(x for x, (_, label) in zip(w, rows) if label == z) for z in (1, 0))
            said.append(min((0.1, 0.999)[y], max((0.001, 0.9)[y], (yes + (0.1, 9.9)[y]) / (yes + no + 10))))
        prior, rate, labelled = min(0.5, max(0.001, (mass[1] + 1) / (sum(mass) + 10))), new, said

    for _ in range(rounds):
        round_()
    q = [posterior(*r) for r in rows]
    spread = [[0.0] * m for _ in range(m)]
    for y in (0, 1):
        w = [x if y else 1 - x for x in q]
        total = max(sum(w), 1)
        mean = [sum(x for x, (votes, _) in zip(w, rows) if v in votes) / total for v in range(m)]
        for a in range(m):
            for b in range(m):
                both = sum(x for x, (votes, _) in zip(w, rows) if a in votes and b in votes) / total
                spread[a][b] += sum(w) / len(rows) * (both - mean[a] * mean[b])
    scale = [math.sqrt(max(spread[v][v], 1e-9)) for v in range(m)]
    weight = [1 / sum(1 if a == b else min(1, max(0, spread[a][b] / scale[a] / scale[b])) ** 2 for a in range(m)) for b in range(m)]
    for _ in range(again):
        round_()
    return prior, rate, weight, labelled, [posterior(*r) for r in rows]


def test_label_model_and_classifier_equal_a_plain_version(spark):
    rng = random.Random(3)
    m, rows = 10, []
    for _ in range(400):
        y = rng.random() < 0.25
        votes = [v for v in range(m) if rng.random() < (0.4 if y and v < 6 else 0.05)]
        rows.append((sorted({*votes, *([1] if 0 in votes else [])}), int(y) if rng.random() < 0.3 else None))
    patterns = spark.createDataFrame([(*r, 1) for r in rows], "votes array<int>, toxic int, n long").groupBy("votes", "toxic").agg(F.sum("n").alias("n")).cache()
    model = tx.fit_labels(patterns, m)
    prior, rate, weight, labelled, q = plain_model(rows, m, tx.ROUNDS, tx.AGAIN)
    assert np.allclose(model.prior, prior) and np.allclose(model.rate, rate) and np.allclose(model.weight, weight) and np.allclose(model.labelled, labelled)
    w = tx.fit_linear(patterns, model, m)
    slope = [0.1 * x for x in w]
    for (votes, _), soft in zip(rows, q):
        error = 1 / (1 + math.exp(-(w[m] + sum(w[v] for v in votes)))) - soft
        for v in [*votes, m]:
            slope[v] += error
    assert max(map(abs, slope)) < 1e-3


def test_toxic_texts_of_any_length_are_mined(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice(["ba", "lo", "ki", "ter"]) for _ in range(3)) for _ in range(4000)]
        if i % 4 == 0:
            words[::20] = ["vexnor"] * len(words[::20])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert b"vexnor" in {w for _, w in tx.mine(df.select("doc_id", "text"), df.select("doc_id", "toxic"))}
