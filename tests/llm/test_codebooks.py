import hashlib

import numpy as np
import pytest

from photonlake.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=codebooks.ROUNDS, n=codebooks.ENTRIES):
    """vec_id -> code and error by comparing every part with every entry, and the codebooks."""
    kept = [(v, [int(np.floor(1024 * float(c))) for c in x], lab) for v, x, lab in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = len(kept[0][1]) // 4
    ids = sorted({v for v, _, _ in kept if v is not None})[:n]
    start = [min(x for v, x, _ in kept if v == i) for i in ids]
    books = [[s[p * width : (p + 1) * width] for s in start] for p in range(4)]

    def find(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            got = {}
            for _, x, _ in kept:
                part = x[p * width : (p + 1) * width]
                got.setdefault(find(books[p], part)[1], []).append(part)
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out = []
    for v, x, lab in kept:
        found = [find(books[p], x[p * width : (p + 1) * width]) for p in range(4)]
        out.append((v, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    totals = {}
    for _, _, e, lab in out:
        totals[lab] = totals.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((v, c, e, totals[lab], digest, lab) for v, c, e, lab in out), key=str)


def random_rows(n, width=8, seed=0, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, width)) / grid if grid else rng.normal(0, 0.2, (n, width))
    return [(i, [float(np.float32(c)) for c in v], int(i % 3)) for i, v in enumerate(x)]


def test_nearest_in_the_tree_against_all_distances():
    rng = np.random.default_rng(1)
    for kind in (np.float64, np.int64):
        for spread, n in ((2, 256), (500, 256), (500, 3), (1, 256)):  # a small spread gives many ties and equal points
            points, queries = rng.integers(-spread, spread + 1, (n, 6)).astype(kind), rng.integers(-spread, spread + 1, (4000, 6)).astype(kind)
            distances = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
            number, distance = codebooks.nearest(codebooks.kd_tree(points), queries)
            assert (number == distances.argmin(axis=1)).all() and (distance == distances.min(axis=1)).all()


@pytest.mark.parametrize("grid", [None, 2])
def test_against_brute_force(spark, grid):
    rows = random_rows(600, grid=grid)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in codebooks.compress(df).collect()), key=str)
    assert got == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(40) + [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [nan] + [0.0] * 7, 1), (903, [-inf] + [0.0] * 7, 1)]
    rows += [(None, [0.25] * 8, None), (None, [0.25] * 8, 7), (3, [-9.0] * 8, None), (5, rows[5][1], 0), (5, rows[5][1], 0), (904, [2000.0] * 8, 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS error", "'s' AS salt", "0 AS x", "'o' AS of")
    got = sorted((tuple(r) for r in codebooks.compress(df).collect()), key=str)
    assert got == brute(rows) and len(got) == 46
    assert codebooks.compress(df.where("vec_id = 900")).count() == 0 and codebooks.compress(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    unnamed = codebooks.compress(spark.createDataFrame([(None, [0.0] * 8, 1), (None, [1.0] * 8, None)], SCHEMA))
    assert sorted(map(tuple, unnamed.collect()), key=str) == [(None, None, None, None, hashlib.sha256(b"").hexdigest(), k) for k in (1, None)]
    for bad in ([(1, [0.0] * 6, 1)], [(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)]):
        with pytest.raises(ValueError):
            codebooks.compress(spark.createDataFrame(bad, SCHEMA))


def test_large_components_are_searched_in_longs(spark):
    rows = [(i, [c * 1e5 for c in x], lab) for i, x, lab in random_rows(60, width=4)]
    rows = [(i, [float(np.float32(c)) for c in x], lab) for i, x, lab in rows]
    got = sorted((tuple(r) for r in codebooks.compress(spark.createDataFrame(rows, SCHEMA), rounds=1).collect()), key=str)
    assert got == brute(rows, rounds=1)
