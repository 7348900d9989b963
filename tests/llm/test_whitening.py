"""Embedding whitening against a plain eigendecomposition, and each of its steps against dense matrices."""

import math

import numpy as np
import pytest

from condensery.llm import whitening
from condensery.llm.whitening import Spectrum, secular_roots

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long"


def dense(spectrum):
    return spectrum.vectors @ np.diag(spectrum.values) @ spectrum.vectors.T


@pytest.mark.parametrize("seed", range(6))
def test_secular_roots(seed):
    rng = np.random.default_rng(seed)
    k = [1, 2, 5, 40, 64, 64][seed]
    poles = np.cumsum(rng.random(k) ** 6 + 1e-9) if seed < 5 else np.concatenate([np.sort(rng.random(k - 1)) * 1e-8, [1e8]])
    z = rng.normal(size=k) * 10.0 ** rng.integers(-4, 2, k)
    roots, delta = secular_roots(poles, z, 0.7)
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(poles) + 0.7 * np.outer(z, z)), rtol=1e-12, atol=1e-12 * roots[-1])
    assert (np.diff(roots) > 0).all() and (roots >= poles).all() and (np.diag(delta) < 0).all()


@pytest.mark.parametrize(("kind", "d"), [("plain", 12), ("flat", 12), ("copies", 12), ("integers", 64), ("one", 1)])
@pytest.mark.parametrize("block", [200, 0, 3])
def test_rows_one_by_one(kind, d, block):
    """In blocks too. Rank-deficient, constant and repeated rows included."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(200, d)) * 200) + 100_000
    if kind == "flat":
        x[:, 3:] = x[:, :1]
    if kind == "copies":
        x[20:190] = x[7]
    held = Spectrum(d)
    for row in x[:block]:
        held.add(row)
    for at in range(block, 200, 30):
        held.add_block(x[at : at + 30])
    centred = x - x.mean(0)
    want = centred.T @ centred
    assert held.n == 200 and np.allclose(held.mean, x.mean(0))
    assert np.allclose(held.vectors.T @ held.vectors, np.eye(d), atol=1e-12)
    assert np.abs(dense(held) - want).max() <= 1e-12 * np.linalg.norm(want)
    assert (np.diff(held.values) >= 0).all()


def test_merge():
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(n, 9)) * rng.random(9) + rng.normal(size=9) * 3 for n in (1, 40, 3, 100, 2)]
    parts.append(np.tile(parts[0], (50, 1)))
    whole, x = Spectrum(9), np.concatenate(parts)
    for p in parts:
        one = Spectrum(9)
        for row in p:
            one.add(row)
        whole.merge(one)
    whole.merge(Spectrum(9))
    centred = x - x.mean(0)
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(0)) and np.allclose(dense(whole), centred.T @ centred)


def check(spark, rows, partitions=1, components=8, left_out=(), block=whitening.BLOCK):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(partitions), components, block).collect()
    kept = [r for r in rows if r[0] not in left_out]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in kept], object)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(v) for v in row] for row in (n * x - sums)]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > values[0] * 1e-12).sum())
    assert len(got) == n * min(components, rank)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    for c, found in by.items():
        assert {r["n"] for r in found.values()} == {n}
        assert all(abs(r["explained"] - values[c - 1] / values.sum()) < 1e-10 for r in found.values())
        w = np.array([found[r[0]]["whitened"] for r in kept])
        want = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-7
    exact = {r[0]: sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for r, row in zip(kept, x, strict=True)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.normal(size=d) * np.linspace(0.1, 1, d)], 1, 2, 3) for i in range(n)]


def test_whitened(spark):
    rows = vectors(3, 300, 20)
    # A very common vector, and rows that are left out.
    rows += [(1000 + i, rows[5][1], 0, 0, 0) for i in range(150)]
    bad = [(2000, None, 0, 0, 0), (2001, [1.0, None] + [0.0] * 18, 0, 0, 0), (2002, [float("nan")] + [0.0] * 19, 0, 0, 0), (2003, [float("-inf")] + [0.0] * 19, 0, 0, 0), (2004, [], 0, 0, 0), (2005, [1.0], 0, 0, 0)]
    check(spark, rows + bad, 40, left_out={r[0] for r in bad})


def test_fewer_components(spark):
    check(spark, vectors(4, 5, 12), 3)
    check(spark, vectors(9, 90, 5), 2, block=1)
    check(spark, vectors(5, 40, 3), 2)
    check(spark, vectors(6, 50, 6), 2, components=2)


def test_nothing_to_whiten(spark):
    one = vectors(7, 1, 4)
    for rows in ([], one, [one[0], one[0]], [(1, None, 0, 0, 0)]):
        got = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(8, 30, 4)
    rows += [rows[0], (None, rows[1][1], 0, 0, 0)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 32 * 4 and sum(r["vec_id"] == 0 for r in got) == 8 and sum(r["vec_id"] is None for r in got) == 4


def test_deviations_beyond_a_long():
    big = whitening.Centre(4, [4 << 40, 0])
    x = np.array([[(1 << 40) + 5, 3], [1 << 45, 0]])
    assert big.deviations(x) == [16 * 25 + 144, None]
