"""Embedding whitening by incremental eigendecomposition.

A spectrum (count, mean, eigenvalues and eigenvectors of the centred sum of squares) stands for the rows seen so far. One more row is a rank-one update: the roots of the
secular equation are the new eigenvalues, and the vectors follow from them; equal eigenvalues and directions that the row doesn't
touch are deflated first. Partitions build their spectra by such updates: of every row, or, where ``block`` rows
together are more than their entries, of the rows of their triangular factor, which has the same centred sum of squares in at most as many rows as a vector has entries. Two spectra are put together by the rank-one update between their means and one for each
eigenvector of the smaller; that goes on in groups of ``FAN``, level by level, so no task holds more than a few matrices of the dimension's size.

Rounding of many updates is taken out by a Rayleigh-Ritz step: each partition projects its rows, centred by the exact mean, on the whole found basis; the small
matrices are added up in the same tree, and the eigenvectors of the sum turn the basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import forget, written

COMPONENTS, SCALE, SHIFT = 8, 1024.0, 100_000
#: Entries from which on floor(1024 * c) has no exact double and long; they count as non-finite.
LARGEST = 2.0**42
#: Rows of a partition that are taken together; 1: each row is an update of its own.
BLOCK = 1024
#: Spectra or matrices that a task puts together.
FAN = 16
#: Directions whose eigenvalue is below this share of the largest, times the dimension, hold rounding only.
RANK = 2.0**-46
EPS = float(np.finfo(np.float64).eps)
#: Bits of the lower part of a sum.
LOW = 26


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum z_j^2 / (poles_j - x), one above each pole, in rising order; with them poles_j - root_i as [i, j], each taken from
    the pole that is closer to the root, so that small differences keep their digits.

    ``poles`` rise strictly, ``rho`` > 0, no z is 0. All roots are sought at once, by rational interpolation between their two poles inside brackets.
    """
    k = len(poles)
    weight = rho * z * z
    upper = np.append(poles[1:], poles[-1] + weight.sum())
    gap = upper - poles
    # The pole on the root's side of the middle is the origin.
    middle = weight / (poles[None, :] - (poles + gap / 2)[:, None])
    at_middle = 1 + middle.sum(1)
    right = at_middle < 0
    right[-1] = False
    away = poles[None, :] - np.where(right, upper, poles)[:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    if at_middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    to_lower, to_upper = np.where(right, -gap, 0.0), np.where(right, 0.0, gap)
    # First the roots where all other poles add what they do in the middle.
    own, next_ = np.diagonal(middle), np.append(np.diagonal(middle, 1), 0)
    with np.errstate(all="ignore"):
        rest = at_middle - own - next_
        x = between(rest, weight, np.append(weight[1:], 0), to_lower, to_upper, low, high)
    left = np.tri(k)
    open_ = np.arange(k)
    for step in range(100):
        here, lo, hi = x[open_], low[open_], high[open_]
        delta = away[open_] - here[:, None]
        with np.errstate(all="ignore"):
            part = weight / delta
            slope = part / delta
            below = left[open_]
            psi, dpsi = (part * below).sum(1), (slope * below).sum(1)
            phi, dphi = part.sum(1) - psi, slope.sum(1) - dpsi
            f = 1 + psi + phi
            lo, hi = np.where(f < 0, here, lo), np.where(f > 0, here, hi)
            done = (np.abs(f) <= 4 * k * EPS * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
            low[open_], high[open_] = lo, hi
            if done.all():
                break
            one, two = to_lower[open_] - here, to_upper[open_] - here
            # Poles of either side as one each, that has their sum and slope here.
            there = here + between(f - one * dpsi - two * dphi, dpsi * one * one, dphi * two * two, one, two, lo - here, hi - here)
        # Now and then the middle of the bracket, should interpolation creep.
        x[open_] = np.where(done, here, (lo + hi) / 2 if step % 8 == 7 else there)
        open_ = open_[~done]
    return np.where(right, upper, poles) + x, away - x[:, None]


def between(rest: np.ndarray, one: np.ndarray, two: np.ndarray, lower: np.ndarray, upper: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of rest + one / (lower - x) + two / (upper - x) between low and high, or their middle where rounding has it elsewhere."""
    # rest * (lower - x) * (upper - x) + one * (upper - x) + two * (lower - x) = 0, as rest * x^2 - b * x + c = 0.
    b = rest * (lower + upper) + one + two
    c = rest * lower * upper + one * upper + two * lower
    root = np.sqrt(np.maximum(b * b - 4 * rest * c, 0))
    big = b + np.where(b >= 0, root, -root)
    first, second = big / (2 * rest), 2 * c / big
    fits = lambda x: (x > low) & (x < high)
    return np.where(fits(second), second, np.where(fits(first), first, (low + high) / 2))


class Spectrum:
    """Count, mean, eigenvalues (rising) and eigenvectors (columns) of the centred sum of squares of rows."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        """One more row."""
        off = x - self.mean
        if self.n:
            self.update(off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def add_block(self, x: np.ndarray) -> None:
        """Some more rows: an update for their mean, and one for each row of their triangular factor."""
        mean, m = x.mean(0), len(x)
        centred = x - mean
        if m > x.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        if self.n:
            self.update(mean - self.mean, self.n * m / (self.n + m))
        for v in centred:
            self.update(v, 1.0)
        self.n += m
        self.mean = self.mean + (mean - self.mean) * (m / self.n)

    def merge(self, other: Spectrum) -> None:
        """All rows of another spectrum, by one update for its mean and one for each of its eigenvectors."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        off = other.mean - self.mean
        self.update(off, self.n * other.n / (self.n + other.n))
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector, float(value))
        self.n += other.n
        self.mean = self.mean + off * (other.n / self.n)

    def update(self, v: np.ndarray, rho: float) -> None:
        """The spectrum after rho * v v^T is added."""
        z = self.vectors.T @ v
        size = float(np.linalg.norm(z))
        if not rho * size * size > 0:
            return
        d, q = self.values, self.vectors
        tolerance = 8 * EPS * max(float(d[-1]), rho * size * size)
        # Deflation: in a run of equal eigenvalues any basis will do; one whose last direction alone is touched.
        close = np.diff(d) <= tolerance
        if close.any():
            d, q, z = d.copy(), q.copy(), z.copy()
            ends = np.flatnonzero(np.append(~close, True)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                if b - a > 1 and (length := float(np.linalg.norm(z[a:b]))) > 0:
                    mirror = z[a:b] / length
                    sign = 1.0 if mirror[-1] >= 0 else -1.0
                    mirror[-1] += sign
                    mirror *= np.sqrt(2) / np.linalg.norm(mirror)
                    q[:, a:b] -= np.outer(q[:, a:b] @ mirror, mirror)
                    z[a:b] = 0
                    z[b - 1] = -sign * length
        # Deflation: directions that are hardly touched stay.
        live = np.abs(z) * rho * size > tolerance
        if not live.any():
            return
        roots, delta = secular_roots(d[live], z[live], rho)
        # The weights for which these roots are exact (Gu and Eisenstat) give orthogonal vectors.
        poles, k = d[live], int(live.sum())
        # Of pole j: (root_i - pole_j) over the gap to the pole that belongs to root i, so that every factor is near one.
        partner = np.where(np.tri(k, dtype=bool), np.append(poles[1:], 0)[:, None], poles[:, None]) - poles[None, :]
        partner[-1] = 1
        weights = np.sqrt(np.maximum((-delta / partner).prod(0), 0) / rho) * np.sign(z[live])
        turn = weights[None, :] / delta
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        values, vectors = d.copy(), q.copy()
        values[live] = roots
        vectors[:, live] = q[:, live] @ turn.T
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def fields(self) -> dict:
        return {"n": self.n, "mean": self.mean.tolist(), "powers": self.values.tolist(), "vectors": self.vectors.reshape(-1).tolist()}

    @staticmethod
    def of(n: int, mean: np.ndarray, powers: np.ndarray, vectors: np.ndarray) -> Spectrum:
        out = Spectrum(len(mean))
        out.n, out.mean, out.values, out.vectors = int(n), np.array(mean, np.float64), np.array(powers, np.float64), np.array(vectors, np.float64).reshape(len(mean), -1)
        return out


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(1024 * c) + 100000 of each entry, as (rows, d) longs."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vectors hold finite entries alone."""
    entry = F.col("embedding")
    fine = entry.isNotNull() & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST)) & (F.size(entry) > 0)
    return vectors.select("vec_id", "embedding").filter(F.coalesce(fine, F.lit(False)))


def tree(table: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``table`` (part, ...; a row for each part) folded to one row, or none, ``FAN`` neighbouring parts at a time."""
    while (top := table.agg(F.max("part")).first()[0]) is not None and top > 0:
        above = written(table.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(fold, schema), "whitening-level")
        forget(table)
        table = above
    return table


SPECTRUM_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("high", "low")), *((c, pa.list_(pa.float64())) for c in ("mean", "powers", "vectors"))])
SPECTRUM = "part long, n long, high array<long>, low array<long>, mean array<double>, powers array<double>, vectors array<double>"
MATRIX = "part long, matrix array<double>"


def spectra(rows: DataFrame, d: int, block: int = BLOCK) -> DataFrame:
    """A spectrum for each partition, and the exact sums of its entries in two parts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, high, low = Spectrum(d), np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = integers(batch.column("embedding"), d)
            high += (x >> LOW).sum(0)
            low += (x & ((1 << LOW) - 1)).sum(0)
            for at in range(0, len(x), block):
                part = x[at : at + block].astype(np.float64)
                if len(part) > 1:
                    held.add_block(part)
                else:
                    held.add(part[0])
        if held.n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "high": high.tolist(), "low": low.tolist(), **held.fields()}], schema=SPECTRUM_ARROW)

    return rows.select("embedding").mapInArrow(build, SPECTRUM)


def merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Some spectra as one; the largest is the one that the others are added to."""
    rows = rows.sort_values("n", ascending=False, kind="stable")
    held = None
    for n, mean, powers, vectors in zip(rows["n"], rows["mean"], rows["powers"], rows["vectors"], strict=True):
        other = Spectrum.of(n, mean, powers, vectors)
        if held is None:
            held = other
        else:
            held.merge(other)
    return pd.DataFrame([{"part": rows["part"].iloc[0], "high": np.sum(np.stack(rows["high"]), 0), "low": np.sum(np.stack(rows["low"]), 0), **held.fields()}])[["part", "n", "high", "low", "mean", "powers", "vectors"]]


def added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"part": rows["part"].iloc[0], "matrix": np.sum(np.stack(rows["matrix"]), 0)}])


class Centre:
    """n rows with exact sums; x - S/n without loss of digits, and exact squared distances."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n * x - S)^2 of each row, exact; null where it is no long."""
        largest = max(map(abs, self.sums), default=0)
        if len(x) and max(largest, self.n * int(np.abs(x).max())) < 1 << 62 and np.square(self.n * self.centred(x)).sum(1).max() < 2.0**62:
            return np.square(self.n * x - np.array(self.sums)).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def projections(rows: DataFrame, d: int, centre: Centre, basis: np.ndarray) -> DataFrame:
    """For each partition the sum over its rows of y y^T, y being a centred row on the basis."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = centre.centred(integers(batch.column("embedding"), d)) @ basis
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["part", "matrix"])

    return rows.select("embedding").mapInArrow(project, MATRIX)


class Whitener:
    """The centre of the fit list, unit components (columns) by falling eigenvalue, and the share of the trace that each explains."""

    def __init__(self, centre: Centre, components: np.ndarray, values: np.ndarray, trace: float):
        self.centre, self.components, self.values, self.explained = centre, components, values, values / trace if len(values) else values

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.values))


def fitted(rows: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitener | None:
    """The whitener of all ``rows``, whose vectors have ``d`` entries; None without rows. Only matrices of the dimension's size come to the driver, one a step."""
    whole = tree(written(spectra(rows, d, block), "whitening-spectra"), merged, SPECTRUM)
    one = whole.first()
    forget(whole)
    if one is None:
        return None
    centre = Centre(one["n"], [(h << LOW) + x for h, x in zip(one["high"], one["low"], strict=True)])
    # Orthogonal to the last digit, whatever the rounding of the updates has come to.
    basis, _ = np.linalg.qr(np.array(one["vectors"]).reshape(d, d)[:, ::-1])
    table = tree(written(projections(rows, d, centre, basis), "whitening-projections"), added, MATRIX)
    ritz = np.array(table.first()["matrix"]).reshape(d, d) / centre.n
    forget(table)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    # Either sign is right; the largest entry is made positive, so that every run gives the same.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    kept = min(components, int((values > max(float(values[0]), 0.0) * RANK * d).sum()))
    return Whitener(centre, vectors[:, :kept], values[:kept], float(np.trace(ritz)))


def dimension(rows: DataFrame) -> int | None:
    """The commonest length of the vectors, the longer one on a tie."""
    one = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return one["d"] if one else None


def whitened(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding) and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, holds null or non-finite entries, or entries of 2^42 or more, are left out; so are rows whose vector has another length than most.
    All others are fitted. Components whose eigenvalue is rounding only (fewer rows than entries, constant entries, equal rows) are not returned: nothing can be whitened there; so
    a single row, or equal rows, give none. Eigenvectors of equal eigenvalues are any basis of theirs, the same for all rows. deviation is null where it is no long.
    Repeated rows and null vec_ids come back as often; an empty table gives no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = usable(vectors)
    d = dimension(rows)
    rows = rows.filter(F.size("embedding") == d) if d else rows
    fit = fitted(rows, d, components, block) if d else None
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("embedding"), d)
            w = fit.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(fit.centre.deviations(x), pa.int64()), lists], ["vec_id", "deviation", "w"])

    made = written(rows.mapInArrow(whiten, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    error = identity_error(made, len(fit.values))
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(e)) for e in fit.explained)), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.centre.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(made: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity, measured over all rows."""
    w = [F.col("w")[i] for i in range(k)]
    means = made.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    centred = [c - F.lit(float(m)) for c, m in zip(w, means, strict=True)]
    moments = made.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    return max(abs(moments[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))
