import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from passledger.llm import whitening

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", LongType())])


def by_hand(vectors, most=16):
    """Per vector: deviation, whitened values (up to sign); explained. From exact whole numbers."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(x[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    far = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in far), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    order = np.argsort(-e)
    e, q = e[order], q[:, order]
    k = min(most, int((e > 1e-11 * e.sum()).sum()))
    centred = np.array([[float(Fraction(n * v[i] - sums[i], n)) for i in range(d)] for v in x])
    deviation = [sum((n * v[i] - sums[i]) ** 2 for i in range(d)) for v in x]
    return n, deviation, centred @ (q[:, :k] / np.sqrt(e[:k])), e[:k] / np.trace(cov)


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(c) for c in v], 0) for k, v in enumerate(vectors)], VECTORS)


@pytest.mark.parametrize("seed,d,n,copies", [(1, 20, 300, 1), (2, 5, 200, 3), (3, 64, 40, 2), (4, 1, 30, 1)])
def test_whitening_by_hand(spark, seed, d, n, copies):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((n, d)) * np.linspace(0.3, 3, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32)
    vectors = np.concatenate([vectors] * copies + [vectors[:1]] * 50)
    seen, deviation, values, explained = by_hand(vectors)
    got = whitening.whitened(frame(spark, vectors).repartition(7)).collect()
    k = values.shape[1]
    assert len(got) == len(vectors) * k and {r.component for r in got} == set(range(1, k + 1))
    made = np.zeros_like(values)
    for r in got:
        assert r.n == seen and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        made[r.vec_id, r.component - 1] = r.whitened
    for c in range(k):
        sign = np.sign(made[np.argmax(np.abs(values[:, c])), c] * values[np.argmax(np.abs(values[:, c])), c])
        np.testing.assert_allclose(made[:, c] * sign, values[:, c], rtol=1e-7, atol=1e-7)


def test_incremental_spectrum_alone():
    """Rank-one updates and merges give the eigenvalues of the scatter before any refinement."""
    rng = np.random.default_rng(9)
    for d, n in ((6, 80), (30, 20), (64, 300)):
        x = np.floor(64 * rng.standard_normal((n, d)) * rng.random(d))
        x[n // 2 :] = x[: n - n // 2] * [1, *[0] * (d - 1)]  # many equal and many empty directions
        parts = []
        for chunk in np.array_split(x, 5):
            s = whitening.Spectrum.empty(d)
            for v in chunk:
                s.add(v)
            parts.append(s)
        for other in parts[1:]:
            parts[0].merge(other)
        centred = x - x.mean(axis=0)
        want = np.linalg.eigvalsh(centred.T @ centred)
        np.testing.assert_allclose(np.sort(parts[0].values), want, rtol=1e-10, atol=1e-9 * want.max())
        q = parts[0].vectors
        np.testing.assert_allclose(q.T @ q, np.eye(d), atol=1e-9)
        np.testing.assert_allclose(q * parts[0].values @ q.T, centred.T @ centred, atol=1e-8 * want.max())


def test_secular_roots():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 50):
        d = np.cumsum(10.0 ** rng.uniform(-9, 2, n))
        z = 10.0 ** rng.uniform(-4, 0, n)
        origin, tau = whitening.secular_roots(d, z, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        np.testing.assert_allclose(d[origin] + tau, want, rtol=1e-12, atol=1e-13 * want[-1])


def test_odd_vectors(spark):
    """Null and non-finite entries, null and empty vectors, other dimensions, repeats, null ids, large entries, no variance."""
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]), (9, [1e30, 0.0])]
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))])
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("__whole", "x", "part", "n", "component", "whitened")})
    got = whitening.whitened(docs).collect()
    ids = [(r.vec_id, r.component) for r in got]  # beside the large entry nothing else has variance, to double precision
    assert sorted(ids, key=str) == sorted([(1, 1), (1, 1), (None, 1), (8, 1), (9, 1)], key=str) and all(r.n == 4 for r in got)
    assert whitening.whitened(docs.where("vec_id = 1")).count() == 0
    assert whitening.whitened(docs.limit(0)).count() == 0
    small = [r for r in whitening.whitened(docs.where("vec_id is null or vec_id in (1, 8)")).collect() if r.vec_id == 8]
    n, deviation, values, _ = by_hand([(1.0, 2.0), (3.0, 1.0), (0.0, 0.0)])
    assert [r.deviation for r in small] == [deviation[2]] * 2 and n == 3
    assert sorted(abs(r.whitened) for r in small) == pytest.approx(sorted(abs(values[2]).tolist()))
