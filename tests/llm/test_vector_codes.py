import hashlib

import numpy as np
import pytest

from docloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string"


def brute(rows):
    """Plain Python integers all the way."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], y) for i, v, y in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    cuts = [(p * d // 8, (p + 1) * d // 8) for p in range(8)]
    books = [[v[a:b] for _, v, _ in kept[:16]] for a, b in cuts]

    def assign(v):
        out = []
        for (a, b), book in zip(cuts, books, strict=True):
            out.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), i) for i, e in enumerate(book)))
        return out

    for _ in range(6):
        found = [assign(v) for _, v, _ in kept]
        for p, (a, b) in enumerate(cuts):
            for e in range(len(books[p])):
                mine = [v[a:b] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [assign(v) for _, v, _ in kept]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    total = {}
    for (_, _, y), f in zip(kept, found, strict=True):
        total[y] = total.get(y, 0) + sum(x for x, _ in f)
    return [(i, "".join(f"{c:02x}" for _, c in f), sum(x for x, _ in f), total[y], sha) for (i, _, y), f in zip(kept, found, strict=True)]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vc.code_report(df).collect()), key=str)


def random_rows(n, d, scale, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * scale).astype(np.float32)
    return [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "scale"), [(200, 16, 0.2), (60, 11, 900.0), (9, 8, 1.0)])
def test_equals_plain_integers(spark, n, d, scale):
    rows = random_rows(n, d, scale)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_bad_rows_copies_ties_and_empty_tables(spark):
    rows = random_rows(30, 16, 1.0)
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[4][1], None), (90, rows[5][1], 0), (91, None, 1), (92, [], 1)]
    rows += [(93, [None] + [0.0] * 15, 1), (94, [float("nan")] * 16, 1), (95, [float("-inf")] * 16, 1), (96, [0.5] * 8, 1), (97, [1e30] * 16, 2)]
    want = brute([r for r in rows if r[0] != 97])
    assert run(spark, rows) == sorted(want, key=str)
    same = [(i, [0.25] * 8, None) for i in range(40)]
    assert run(spark, same) == sorted(brute(same), key=str)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []


def test_products_are_exact_in_several_limbs():
    rng = np.random.default_rng(4)
    for size in (10, 26, 27):
        a, b = (rng.integers(-(1 << size), 1 << size, (n, 8)) for n in (40, 16))
        assert len(vc.limbs(a, 24)) == (1 if size < 24 else 2)
        assert (vc.exact_products(a, b) == a.astype(object) @ b.T.astype(object)).all()
    assert (vc.exact_products(a, b) == a @ b.T).all()
    wide = rng.integers(-(1 << 40), 1 << 40, (5, 8))
    assert (vc.exact_products(wide, a[:3]) == wide @ a[:3].T).all()
    assert sum(x * 2.0 ** (5 * i) for i, x in enumerate(vc.limbs(np.array([[-77, 1000]]), 5))).tolist() == [[-77.0, 1000.0]]
