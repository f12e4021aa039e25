"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps a spectrum: how many vectors it has seen, their mean, and the eigenvalues and eigenvectors of their
scatter about it. A new vector is a rank-one update along its distance to the mean: the new eigenvalues are the roots of a
secular equation (found between neighbouring poles, all at once), the new eigenvectors follow from them in closed form.
Directions that the update does not touch, and all but one of each group of equal eigenvalues, are deflated first. Two
spectra are combined by the same step: one update for the distance of the means and one for each eigenpair of the smaller.
Spectra meet eight at a time until one is left; its eigenvectors are the basis of a Rayleigh-Ritz step over all vectors, which
gives the eigenpairs to double precision.

Sums and deviations are whole numbers and exact. What travels is a spectrum or a square matrix of the dimension per task,
never vectors; the driver holds one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import cut, unused

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of diag(d) + rho z z', as (origin, distance): root k is d[origin[k]] + distance[k].

    d rises strictly, no z is zero, rho > 0. Root k lies between d[k] and d[k + 1] (the last one rho z'z further at most).
    Each is iterated from its nearer pole by the middle way (a rational function that meets value and slope), and halves its bracket
    where that leaves it.
    """
    n = len(d)
    w = rho * z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    middle = (upper - d) / 2
    gap = d[None, :] - d[:, None]  # gap[k, j] = d[j] - d[k]
    at_middle = 1 + (w[None, :] / (gap - middle[:, None])).sum(axis=1)
    right = at_middle < 0
    right[-1] = False
    origin = np.arange(n) + right
    delta = d[None, :] - d[origin][:, None]
    low = np.where(right, -middle, 0.0)
    high = np.where(right, 0.0, middle)
    low[-1], high[-1] = (middle[-1], 2 * middle[-1]) if at_middle[-1] < 0 else (0.0, middle[-1])
    tau = (low + high) / 2
    below = np.arange(n)[None, :] <= np.arange(n)[:, None]
    near, far = delta[np.arange(n), np.arange(n)], np.append(delta[np.arange(n - 1), np.arange(1, n)], upper[-1] - d[-1])
    left = np.arange(n)
    for _ in range(120):
        t = tau[left]
        away = delta[left] - t[:, None]
        part = w[None, :] / away
        low_part, slope = np.where(below[left], part, 0.0), part / away
        psi, phi = low_part.sum(axis=1), (part - low_part).sum(axis=1)
        f = 1 + psi + phi
        high[left] = np.where(f >= 0, t, high[left])
        low[left] = np.where(f < 0, t, low[left])
        width = high[left] - low[left]
        open_ = (np.abs(f) > 2 * EPS * n * (1 + np.abs(psi) + np.abs(phi))) & (width > 2 * EPS * np.abs(t)) & (width > 0)
        if not open_.any():
            break
        psi_slope = np.where(below[left], slope, 0.0).sum(axis=1)
        phi_slope = slope.sum(axis=1) - psi_slope
        x, y = near[left] - t, far[left] - t
        a = (x + y) * f - x * y * (psi_slope + phi_slope)
        b = x * y * f
        c = f - x * psi_slope - y * phi_slope
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t + step
        inside = np.isfinite(new) & (new > low[left]) & (new < high[left])
        tau[left] = np.where(open_, np.where(inside, new, (low[left] + high[left]) / 2), t)
        left = left[open_]
    return origin, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, along: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of Q diag(values) Q' + rho v v', rho >= 0."""
    z = vectors.T @ along
    size = float(np.sqrt(z @ z))
    if rho <= 0 or size == 0:
        return values, vectors
    z, rho = z / size, rho * size * size
    order = np.argsort(values, kind="stable")
    d, z, q = values[order], z[order], vectors[:, order]
    tiny = 8 * EPS * max(abs(d[-1]), abs(d[0]), rho)
    group = np.concatenate([[0], np.cumsum(np.diff(d) > tiny)])
    if group[-1] < len(d) - 1:  # equal eigenvalues: turn their vectors so that one of them takes all of z
        for g in np.flatnonzero(np.bincount(group) > 1):
            at = np.flatnonzero(group == g)
            part = z[at].copy()
            length = np.sqrt(part @ part)
            if length > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                q[:, at] -= 2 * np.outer(q[:, at] @ mirror, mirror)
                z[at] = 0.0
                z[at[-1]] = -np.copysign(length, part[-1])
    live = np.flatnonzero(rho * np.abs(z) > tiny)
    if len(live) == 0:
        return d, q
    dl, zl = d[live], z[live]
    origin, tau = secular_roots(dl, zl, rho)
    roots = dl[origin] + tau
    away = (dl[None, :] - dl[origin][:, None]) - tau[:, None]  # d[j] - root[k]
    gap = dl[None, :] - dl[:, None]
    np.fill_diagonal(gap, 1.0)
    exact = np.sqrt(np.abs(np.prod(-away / np.where(np.eye(len(live), dtype=bool), 1.0, -gap), axis=0)))  # of the z that has just these roots
    parts = (np.copysign(exact, zl)[None, :] / away).T
    parts /= np.sqrt((parts * parts).sum(axis=0))[None, :]
    q[:, live] = q[:, live] @ parts
    d[live] = roots
    return d, q


class Spectrum:
    """Vectors seen, their mean, and eigenvalues and eigenvectors of their scatter about it."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, np.zeros(dimension), np.zeros(dimension), np.eye(dimension))

    def add(self, x: np.ndarray) -> None:
        delta = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + delta / self.n

    def merge(self, other: Spectrum) -> None:
        if other.n == 0:
            return
        n, delta = self.n + other.n, other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, max(float(value), 0.0))
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.n * other.n / n)
        self.mean = self.mean + delta * (other.n / n)
        self.n = n


def points(vectors: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows that remain, with their whole numbers (less 1,000,000) as `name`, and the dimension."""
    ok = "embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
    rows = vectors.where(F.expr(ok))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    whole = F.transform("embedding", lambda c: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(c.cast("double") * SCALE).cast("double"))).cast("long"))
    return rows.where(F.size("embedding") == d).withColumn(name, whole), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _folded(rows: DataFrame, schema: str, combine: Callable[[pd.DataFrame], pd.DataFrame], width: int = 8) -> pd.DataFrame | None:
    """Rows (part, ...) combined `width` at a time, in tasks, until one is left. The rows are stored after each round."""
    while True:
        rows = cut(rows)
        n = rows.count()
        if n <= 1:
            out = rows.toPandas()
            return out if len(out) else None
        grouped = rows.withColumn("part", F.floor(F.col("part") / width).cast("long"))
        rows = grouped.repartition(max(1, n // width), "part").groupBy("part").applyInPandas(combine, schema)


def _spectra(fit: DataFrame, d: int) -> np.ndarray:
    """An orthonormal basis of rising eigenvalues, from the spectra of the partitions."""
    schema = "part long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"

    def row(part: int, s: Spectrum) -> dict:
        return {"part": [part], "n": [s.n], "mean": [s.mean], "eigenvalues": [s.values], "eigenvectors": [s.vectors.ravel()]}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part = Spectrum.empty(d), None
        for batch in batches:
            for p, x in zip(batch.column("part").to_pylist(), _matrix(batch.column("x"), d).astype(float), strict=True):
                part = p
                s.add(x)
        if s.n:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(row(part, s)), preserve_index=False)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        held = [Spectrum(int(r.n), np.array(r.mean), np.array(r.eigenvalues), np.array(r.eigenvectors).reshape(d, d)) for r in frame.itertuples(index=False)]
        held.sort(key=lambda s: -s.n)
        for other in held[1:]:
            held[0].merge(other)
        return pd.DataFrame(row(int(frame["part"].iloc[0]), held[0]))

    local_rows = fit.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(local, schema)
    last = _folded(local_rows, schema, combine)
    return np.linalg.qr(np.array(last["eigenvectors"][0]).reshape(d, d))[0]


def _moments(fit: DataFrame, d: int, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Sum of y y' over the fit list, y the centred vectors times the basis."""
    k = basis.shape[1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, centre = np.zeros((k, k)), None, _Centre(n, sums)
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for at in range(0, batch.num_rows, 4096):
                y = centre.of(_matrix(batch.column("x").slice(at, 4096), d)) @ basis
                total += y.T @ y
        if part is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": [part], "moments": [total.ravel()]}), preserve_index=False)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "moments": [np.sum(np.stack(frame["moments"].tolist()), axis=0)]})

    schema = "part long, moments array<double>"
    last = _folded(fit.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(local, schema), schema, combine)
    return np.array(last["moments"][0]).reshape(k, k)


class _Centre:
    """Differences from the mean: n x - S in whole numbers, divided last."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.small = n * LARGEST < 1 << 62
        self.array = np.array(sums, dtype=np.int64 if self.small else object)

    def whole(self, x: np.ndarray) -> np.ndarray:
        return (x if self.small else x.astype(object)) * self.n - self.array

    def of(self, x: np.ndarray) -> np.ndarray:
        return (self.whole(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        whole = self.whole(x)
        if self.small and float(np.abs(whole).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (whole * whole).sum(axis=1).tolist()
        exact = [sum(int(c) * int(c) for c in r) for r in whole]
        return [v if v < 1 << 63 else None for v in exact]


class Whitening:
    """n, sums, eigenvalues (falling), components (as columns), trace, identity_error."""

    def __init__(self, fit: DataFrame, d: int) -> None:
        self.d = d
        self.n = fit.count()
        self.sums = [0] * d
        for r in fit.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect():
            self.sums[r.k] = int(r.s)
        self.values, self.components, self.trace, self.identity_error = np.zeros(0), np.zeros((d, 0)), 0.0, 0.0
        if self.n == 0:
            return
        basis = _spectra(fit, d)
        found = _moments(fit, d, self.n, self.sums, basis) / self.n
        values, turn = np.linalg.eigh((found + found.T) / 2)
        order = np.argsort(-values, kind="stable")
        self.trace = float(np.trace(found))
        real = order[values[order] > 100 * EPS * d * max(self.trace, 0.0)]
        self.values, self.components = values[real], basis @ turn[:, real]

    def check(self, fit: DataFrame, most: int) -> None:
        """Measure, over the fit list, how far the covariance of the whitened vectors is from the identity."""
        k = min(most, len(self.values))
        if k:
            seen = _moments(fit, self.d, self.n, self.sums, self.components[:, :k] / np.sqrt(self.values[:k])) / self.n
            self.identity_error = float(np.abs(seen - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """One row per remaining row of `vectors` and component up to `most`: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty or holds null or non-finite entries go; of vectors of several dimensions those of the
    commonest stay (of ties, the larger). An entry c counts as floor(64 c) + 1,000,000; beyond 2^40 the floor is held there.
    The model is fitted on each distinct vector once. Components are numbered by falling eigenvalue; equal eigenvalues have no
    order of their own. Directions without variance, to double precision, are no components: n equal vectors give no row, an
    empty table neither. A deviation beyond a long is null. Rows that repeat a vec_id, or have none, all give rows.
    """
    (name,) = unused(vectors, "whole")
    rows, d = points(vectors, name)
    if d == 0:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = cut(rows.select(F.col(name).alias("x")).distinct())
    model = Whitening(fit, d)
    model.check(fit, most)
    k = min(most, len(model.values))
    n, sums, scale = model.n, model.sums, model.components[:, :k] / np.sqrt(model.values[:k])
    explained, error = model.values[:k] / (model.trace or 1.0), model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = _Centre(n, sums)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch.column("x"), d)
                m = len(x)
                far = pa.array(centre.deviations(x), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far.take(each),
                     pa.array((centre.of(x) @ scale).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).alias("x"))
    return narrow.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
