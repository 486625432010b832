import numpy as np
import pytest

from docloom.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


def brute(rows, k, every):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            best = sorted({(-float((a * b).sum()), i) for i, b in fine if i != q and len(b) == len(a)})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def run(spark, rows, k, every=20):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in nb.nearest(df, df.where(f"vec_id % {every} = 0"), k).collect())


@pytest.mark.parametrize("blocks", [(16_384, 512), (150, 7)])
def test_recall_and_exact_scores(spark, blocks, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_VECTORS", blocks[0])
    monkeypatch.setattr(nb, "BLOCK_QUERIES", blocks[1])
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    x = np.concatenate([centres[rng.integers(0, 6, 500)] + 0.2 * rng.normal(size=(500, 24)), rng.normal(size=(300, 24))]) * rng.uniform(0.5, 2, size=(800, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    want, got = brute(rows, 20, 20), run(spark, rows, 20)
    exact = {(q, i): s for q, _, i, s in brute(rows, 10_000, 20)}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, _, i, s in got)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_copies_bad_vectors_and_small_tables(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(201, [9.0, 9.0, 9.0]), (202, None), (203, [0.0, 0.0, 0.0]), (204, [1.0, None, 2.0]), (205, [1.0, float("nan"), 2.0]), (206, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (220, [1.0, 1.0]), (240, []), (207, [1.0, 2.0, 3.0]), (207, [1.0, 2.0, 3.0])]
    assert run(spark, rows, 5) == sorted(brute(rows, 5, 20))
    few = rows[:4]
    assert run(spark, few, 20) == sorted(brute(few, 20, 20))
    assert run(spark, [], 20) == []
    assert run(spark, [(1, [1.0])], 20) == []


def test_every_row_many_times_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    want = sorted(brute(rows, 20, 20))
    assert len(want) == 60 and run(spark, rows * 30, 20) == want
    several = rows + [(i % 60, rows[(i * 7) % 60][1]) for i in range(30)]
    got = run(spark, several, 5)
    pairs = {}
    for q, a in several:
        if q % 20 == 0:
            pairs.setdefault(q, set()).update((-float((np.array(a) * np.array(b)).sum()), i) for i, b in several if i != q)
    assert [(q, i) for q, _, i, _ in got] == [(q, i) for q in sorted(pairs) for _, i in sorted(pairs[q])[:5]]


@pytest.mark.parametrize("kind", ["random", "groups"])
@pytest.mark.parametrize("blocks", [1, 2])
def test_recall_on_full_blocks(kind, blocks):
    n, k = blocks * nb.BLOCK_VECTORS, 20
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 64))
    if kind == "groups":
        x = rng.normal(size=(n // 200, 64))[rng.integers(0, n // 200, n)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, n, n // 50)[:50]
    found = {int(q): [] for q in asked}
    for b in range(blocks):
        own = np.arange(b, n, blocks)
        for q, ids, scores in nb.Index(own, x[own], 1 + 1e-12, 7).search(x[asked], asked, k):
            found[q] += zip(-scores, ids, strict=True)
    got = {(q, int(i)) for q, some in found.items() for _, i in sorted(some)[:k]}
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(int(q), int(i)) for q, s in zip(asked, score, strict=True) for i in np.argsort(-s)[:k]}
    assert len(got & want) >= 0.99 * len(want)


def test_closing_count_holds_for_the_kth_best():
    rng = np.random.default_rng(2)
    for radius, distance in [(1.0, 1.0), (1.139, 1.11), (1.0, 0.8), (0.5, 0.25)]:
        inside = (np.abs(rng.normal(size=(100_000, nb.DIRECTIONS)) * distance) <= radius).sum(axis=1)
        assert (inside >= nb.closing_count(radius, distance**2)).mean() >= 0.9995
    assert nb.closing_count(0.1, 0.0) == nb.closing_count(0.1, -1e-16) == nb.DIRECTIONS
