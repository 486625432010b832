import itertools
import random

import numpy as np
import pytest

from docloom.llm import crf, language_id


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_forward_backward_equals_enumeration(block):
    rng = np.random.default_rng(block)
    k, lengths = 3, [1, 5, 0, 4, 7, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, change = rng.normal(size=(first[-1], k)), rng.normal(size=(k, k))
    want, moves = np.zeros_like(score), np.zeros((k, k))
    for a, b in itertools.pairwise(first):
        if a == b:
            continue
        total, here, step = 0.0, np.zeros((b - a, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=b - a):
            entry = np.exp(change[:, path[0]]).sum() / k  # any label may stand before the first word
            w = entry * np.exp(sum(score[a + i, y] for i, y in enumerate(path)) + sum(change[x, y] for x, y in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                here[i, y] += w
            for x, y in itertools.pairwise(path):
                step[x, y] += w
        want[a:b] = here / total
        moves += step / total
    got, changes = crf.posteriors(score, first, change, block)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(changes, moves, atol=1e-5)


def invented(rng, lang, n):
    parts = {"aa": ["ba", "lo", "ki", "ma"], "bb": ["sch", "ung", "ter", "ß"], "cc": ["éa", "çon", "que", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(4)
    rows = [(i, invented(rng, lang, rng.randint(3, 40)), lang) for i in range(240) for lang in [rng.choice(["aa", "bb", "cc"])]]
    mixed = invented(rng, "aa", 30) + " " + invented(rng, "bb", 10)
    odd = [(900, None, "aa"), (901, "", None), (902, "12 !? --", "bb"), (903, "…", None), (904, mixed.upper(), None), (905, "éé", None), (906, invented(rng, "cc", 60_000), "cc"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, source string").repartition(4)
    held = language_id.held_out(3, 1)
    model = language_id.fit(df.where(~held), texts=60)
    got = language_id.predict(df, model).join(df.select("doc_id", "lang", held.alias("held")).distinct(), "doc_id").collect()
    test = [r for r in got if r.held and r.doc_id < 900]
    assert len(got) == len(rows) + len(odd) and len(test) > 40
    assert sum(r.lang_pred == r.lang for r in test) >= 0.95 * len(test)
    one = {r.doc_id: r for r in got}
    assert [one[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4 and one[901].score == 0
    assert one[904].lang_pred == "aa" and 0.6 < one[904].score < 0.9 and one[906].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language_id.fit(df) is None
    assert {(r.lang_pred, r.score) for r in language_id.predict(df, None).collect()} == {("und", 0.0)}
    assert language_id.predict(df.limit(0), None).count() == 0


def test_a_language_of_long_texts_is_learned_alike_at_every_run(spark):
    rng = random.Random(6)
    rows = [(i, invented(rng, "aa", 30), "aa") for i in range(8)] + [(100 + i, invented(rng, "bb", 5000), "bb") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.fit(df.repartition(n, "doc_id")) for n in (2, 5)]
    assert models[0].labels == ["aa", "bb"] and (models[0].grams == models[1].grams).all()
    asked = spark.createDataFrame([(1, invented(rng, "bb", 40)), (2, invented(rng, "aa", 40))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, models[0]).collect()} == {1: "bb", 2: "aa"}
    piece = df.where("doc_id = 100").select("text", language_id.run_of_words("text", 500).alias("run")).first()
    assert 0 < len(piece.run) <= 500 and f" {piece.run} " in f" {piece.text} "
    assert language_id.keep_known(df, None).count() == len(rows)
