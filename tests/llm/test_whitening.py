from fractions import Fraction

import numpy as np
import pytest

from photonlake.llm import whitening
from photonlake.llm.whitening import Moments

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width)) @ np.diag(np.linspace(0.3, 1.5, width)) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]


def integers(rows):
    return np.array([[int(np.floor(64 * c)) + 1_000_000 for c in x] for _, x, _ in rows], np.int64)


def test_against_the_contract_on_all_vectors(spark):
    rows = vectors(400, 40)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).toPandas()
    x = integers(rows)
    n, s = len(x), x.sum(axis=0)
    assert len(got) == 400 * 32 and (got.n == 400).all() and set(got.component) == set(range(1, 33))
    deviation = {i: sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert (got.deviation == got.vec_id.map(deviation)).all()
    mean = [Fraction(int(t), n) for t in s]
    centred = np.array([[float(int(c) - m) for c, m in zip(v, mean, strict=True)] for v in x])
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / values.sum(), rtol=1e-10)
    assert abs(w.T @ w / n - np.eye(32)).max() < 1e-9 and abs(w.mean(axis=0)).max() < 1e-9
    assert (got.identity_error == got.identity_error[0]).all() and got.identity_error[0] < 1e-9
    # a component projects on an eigenvector: covariance with the vectors is the eigenvalue along it
    along = centred.T @ w / n / np.sqrt(values[:32])
    assert np.allclose(along.T @ along, np.eye(32), atol=1e-8)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (300, 6)) + 10_000_000
    whole = Moments.of(x)
    parts = [Moments.of(x[a:b]) for a, b in ((0, 1), (1, 100), (100, 290), (290, 300))]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        m = parts[order[0]]
        for k in order[1:]:
            m = m.merged(parts[k])
        assert m.n == 300 and m.sums == x.sum(axis=0).tolist()
        assert np.allclose(m.scatter, whole.scatter, rtol=1e-9, atol=1e-6)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(50, 6)
    bad = [(900, None, 1), (901, [None] + [0.0] * 5, 1), (902, [nan] + [0.0] * 5, 1), (903, [inf] + [0.0] * 5, 1)]
    more = [(None, [0.5] * 6, None), (3, rows[3][1], None), (3, rows[3][1], None)]
    df = spark.createDataFrame(rows + bad + more, SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 53 * 6 and (got.n == 53).all() and got.identity_error[0] < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 == whitening.whiten(df.where("vec_id = 902")).count()
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], SCHEMA))


def test_components_without_variance(spark):
    rows = [(i, [x[0], 1.0, x[0], x[1]], lab) for i, x, lab in vectors(30, 4)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 120 and got[got.component > 2].whitened.isna().all() and (got[got.component > 2].explained < 1e-12).all()
    assert got[got.component <= 2].whitened.notna().all() and got.identity_error[0] < 1e-9
    equal = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).toPandas()
    assert len(equal) == 10 and equal.whitened.isna().all() and equal.explained.isna().all() and (equal.deviation == 0).all()


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(np.float32(c * 1e6)) for c in x], lab) for i, x, lab in vectors(200, 3)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    x = integers(rows)
    s = [int(t) for t in x.sum(axis=0)]
    assert dict(got.dtypes)["deviation"] == "decimal(38,0)"
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == {i: sum((200 * int(c) - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
