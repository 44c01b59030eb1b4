import math

import numpy as np
import pytest

from tallyloom.llm import whitening

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, k=4):
    """The contract by a covariance matrix and exact Python integers: {(vec_id, component): row}, and the components."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    e, vectors = e[::-1], vectors.T[::-1]
    out = []
    for i, x in kept:
        off = np.array([n * a - s for a, s in zip(x, sums)], float) / n
        for j in range(min(k, len(sums))):
            out.append((i, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), off @ vectors[j] / math.sqrt(e[j]), e[j] / e.sum()))
    return out


def agree(got, want):
    got, want = (sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])) for rows in (got, want))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want):
        if abs(w[4]) > 0.5:
            signs.setdefault(g["component"], np.sign(g["whitened"] * w[4]))
    for g, w in zip(got, want):
        assert g["whitened"] == pytest.approx(signs[g["component"]] * w[4], abs=1e-8)
        assert g["explained"] == pytest.approx(w[5], rel=1e-9)
        assert 0 <= g["identity_error"] <= 1e-9


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + rng.normal(size=12)
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    return rows + [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[3][1]), (4, rows[4][1])]


def test_against_a_covariance_matrix(spark, some):
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [1.0] * 3), (905, [])]
    docs = spark.createDataFrame([(*r, 1) for r in some + odd], KIND).repartition(7)
    agree(whitening.whiten_vectors(docs).collect(), plain(some))


def test_a_deep_tree_of_factors_gives_the_same(spark, some, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 60)
    docs = spark.createDataFrame([(*r, 1) for r in some], KIND)
    x = whitening.integers(docs).select("x").distinct().repartition(13)
    fit = [r["x"] for r in x.collect()]
    n, sums = len(fit), tuple(map(sum, zip(*fit)))
    r = whitening.last_factor(x, n, sums)
    c = np.array(fit, float) - np.array(sums) / n
    assert r.T @ r == pytest.approx(c.T @ c, rel=1e-10)
    agree(whitening.whiten_vectors(docs.repartition(11)).collect(), plain(some))


def test_exact_whatever_the_size():
    rng = np.random.default_rng(5)
    for top in (10, 2**20, 2**40, 2**61, 2**63 - 1):
        x = rng.integers(-top, top, (20, 5))
        n, sums = 1_000_003, tuple(int(v) * 7 for v in rng.integers(-top, top, 5))
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, n, sums) == [v if v < 2**63 else None for v in want]
        assert whitening.centred(x, n, sums) == pytest.approx(np.array([[float(a) - s / n for a, s in zip(row, sums)] for row in x.tolist()]), rel=1e-9, abs=1e-6)


def test_few_vectors_and_few_dimensions(spark):
    one = whitening.whiten_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], KIND)).collect()
    assert sorted(tuple(r) for r in one) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    two = whitening.whiten_vectors(spark.createDataFrame([(1, [1.0, 2.0, 0.0], 0), (2, [3.0, 2.0, 0.0], 0)], KIND)).collect()
    assert {(r["vec_id"], r["component"], r["deviation"]) for r in two} == {(i, c, 512**2) for i in (1, 2) for c in (1, 2, 3)}
    first = sorted(r["whitened"] for r in two if r["component"] == 1)
    assert first == pytest.approx([-1, 1]) and all(r["whitened"] is None for r in two if r["component"] > 1)
    assert {r["explained"] for r in two if r["component"] == 1} == {1.0}
    assert whitening.whiten_vectors(spark.createDataFrame([], KIND)).collect() == []
    assert whitening.whiten_vectors(spark.createDataFrame([(1, None, 0), (2, [], 0)], KIND)).collect() == []


def test_clashing_columns_and_far_entries(spark):
    from pyspark.sql import functions as F

    own = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.5]), (3, [0.0, 0.25])], "vec_id long, embedding array<double>")
    clash = own.withColumns({"x": F.lit("a"), "deviation": F.lit(1), "whitened": F.lit(2), "n": F.lit(3)})
    got = whitening.whiten_vectors(clash).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 3)
