"""Whitening against numpy's eigenvectors, and the eigen solver on hard matrices."""

import math

import numpy as np
import pytest

from inkveil.llm import whitening
from inkveil.llm.symmetric import leading, sturm_counts, tridiagonal

SCHEMA = "vec_id long, embedding array<float>, component string, n double, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 0.5, 1) for r in rows], SCHEMA)


def matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    few = rng.normal(size=(20, 90))
    side = np.diag(np.ones(20), 1)
    return {
        "equal": np.eye(12), "zero": np.zeros((4, 4)), "rank one": np.ones((6, 6)), "single": np.array([[2.0]]), "pair": np.array([[2.0, 1], [1, 2]]),
        "clusters": q @ np.diag([5.0] * 10 + [3.0] * 10 + [1e-9] * 20) @ q.T, "low rank": few.T @ few,
        "near pairs": np.diag(np.abs(np.arange(21) - 10.0)) + side + side.T, "falling": np.diag(10.0 ** -np.arange(12)), "large": np.eye(5) * 1e200,
    }


@pytest.mark.parametrize("name", matrices())
def test_leading_pairs(name):
    a = matrices()[name]
    values, vectors = leading(a, 16)
    size = max(np.abs(a).max(), 1e-300)
    want = np.linalg.eigvalsh(a / size)[::-1][:16]
    assert np.abs(values / size - want).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs((a / size) @ vectors - vectors * (values / size)).max() < 1e-13


def test_counts_of_a_known_matrix():
    diagonal, off, _ = tridiagonal(np.diag([1.0, 2.0, 2.0, 5.0]))
    assert sturm_counts(diagonal, off, np.array([0.5, 1.5, 2.5, 6.0])).tolist() == [0, 1, 3, 4]
    assert len(leading(np.zeros((0, 0)), 3)[0]) == 0


def model(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    y = ((n * x - sums) / n).astype(np.float64)
    values, parts = np.linalg.eigh(y.T @ y / n)
    return deviation, np.abs(y @ parts[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])), values[::-1][:k] / values.sum()


def test_whiten_matches_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0.3, 1, (400, 40)) * np.linspace(0.5, 3, 40))]
    data += [(7, data[7][1]), (None, data[9][1])]
    bad = [(900, None), (901, [1.0, None] * 20), (902, [math.nan] * 40), (903, [math.inf] * 40), (904, [-math.inf] * 40), (905, []), (906, [1.0])]
    out = whitening.whiten(frame(spark, data + bad).repartition(5))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    deviation, whitened, explained = model([v for _, v in data], 32)
    assert len(rows) == 32 * len(data)
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == len(data) and r["identity_error"] < 1e-9 and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    for i, (key, _) in enumerate(data):
        for c in range(32):
            found = got[key, c + 1]
            assert len(found) == (2 if key == 7 else 1)
            assert all(r["deviation"] == deviation[i] and abs(abs(r["whitened"]) - whitened[i, c]) < 1e-8 for r in found)
    # one sign for all rows of a component
    y = np.array([[got[i, c + 1][0]["whitened"] for c in range(32)] for i in range(400) if i != 7])
    assert np.abs(np.abs(np.corrcoef(y.T)) - np.eye(32)).max() < 0.05


def test_far_offsets_cost_no_digits(spark):
    rows = [(i, [1e6 + i % 3, 1e6 - i % 5]) for i in range(60)]
    out = whitening.whiten(frame(spark, rows)).collect()
    deviation, whitened, _ = model([v for _, v in rows], 2)
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in out)
    assert all(abs(abs(r["whitened"]) - whitened[r["vec_id"], r["component"] - 1]) < 1e-9 for r in out)


def test_deviations_beyond_products_of_64_bits(spark):
    apart = np.array([[0, 3], [10**9, -5]], dtype=np.int64)
    want = [sum((4 * int(x) - s) ** 2 for x, s in zip(row, (7, 9), strict=True)) for row in apart]
    assert whitening._deviations(apart[:1], 4, (7, 9)).tolist() == want[:1]
    wide = np.array([[7 * 10**8, 0]], dtype=np.int64)
    assert whitening._deviations(wide, 4, (7, 9)).tolist() == [(28 * 10**8 - 7) ** 2 + 81]
    with pytest.raises(OverflowError):
        whitening._deviations(apart, 4, (7, 9))


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, None)], [(1, []), (2, [])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.columns[0] == "vec_id" and out.collect() == []


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 3.0]) for i in range(50)]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in out} == {1} and abs(out[0]["explained"] - 1) < 1e-12
