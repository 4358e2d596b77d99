"""Operator 11 against dense linear algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipgraph.llm import whitening as wh

from .conftest import SF, needs_data


@pytest.mark.parametrize("n", (1, 2, 3, 8, 40))
def test_solver_finds_singular_values(n):
    rng = np.random.default_rng(n)
    for scale in (np.ones(n), 10.0 ** -np.arange(n)):
        a = rng.standard_normal((n, n)) * scale
        d, f, p = wh.bidiagonal(a)
        assert np.allclose(p.T @ p, np.eye(n), atol=1e-13)
        b = np.diag(d) + (np.diag(f, 1) if n > 1 else 0)
        assert np.allclose((a @ p).T @ (a @ p), b.T @ b, atol=1e-12)
        got, want = wh.singular_values(d, f), np.linalg.svd(b, compute_uv=False)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-15 * want[0])


def test_small_singular_values_are_relatively_accurate():
    d, f = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1.0, 1e-4, 1e-8])
    got = wh.singular_values(d, f)
    assert math.isclose(np.prod(got), np.prod(d), rel_tol=1e-12)


@pytest.mark.parametrize("kind", ("random", "repeated", "zero", "identity", "graded"))
def test_directions(kind):
    rng = np.random.default_rng(7)
    a = {"random": rng.standard_normal((200, 12)),
         "repeated": np.vstack([np.eye(12), -np.eye(12)]),
         "zero": np.zeros((5, 12)), "identity": np.eye(12) + 1e-9 * rng.standard_normal((12, 12)),
         "graded": rng.standard_normal((200, 12)) * 3.0 ** -np.arange(12)}[kind]
    r = np.linalg.qr(np.vstack([a, np.zeros((12, 12))]), mode="r")
    s, v = wh.components(r, 12)
    want = np.linalg.svd(a, compute_uv=False)
    want = want[want > 12 * wh.EPS * want[0]]
    assert np.allclose(s, want, rtol=1e-10)
    assert np.allclose(v.T @ v, np.eye(len(s)), atol=1e-10)
    assert np.allclose(v.T @ (a.T @ a) @ v, np.diag(s ** 2), atol=1e-10 * max(want.max(initial=0) ** 2, 1))


def brute(rows):
    ok = [(i, v) for i, v in rows if v is not None
          and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for i, v in ok]
    fit = np.array(sorted({x for _, x in xs}), np.int64)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    return {i: (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)),
                ((np.array(x) * n - s) / n) @ v / np.sqrt(np.abs(e)), e / np.trace(cov))
            for i, x in xs}


def held(df, rows, k):
    want, got = brute(rows), {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert got.keys() == want.keys()
    sign = {}
    for i, (n, dev, w, share) in want.items():
        assert sorted(got[i]) == list(range(1, k + 1))
        for j in range(k):
            for r in got[i][j + 1]:
                assert (r["n"], r["deviation"]) == (n, dev)
                assert math.isclose(r["explained"], share[j], rel_tol=1e-9)
                assert r["identity_error"] < 1e-9
                if abs(w[j]) > 1e-3:
                    assert sign.setdefault(j, np.sign(w[j] * r["whitened"])) == \
                        np.sign(w[j] * r["whitened"])
                assert math.isclose(abs(r["whitened"]), abs(w[j]), rel_tol=1e-7, abs_tol=1e-7)


def test_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(6))]) for i in range(80)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, [1.0, None] + [0.0] * 4),
             (103, [float("nan")] + [0.0] * 5), (104, [float("inf")] + [0.0] * 5),
             (None, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7) \
        .withColumn("component", F.lit("clash"))
    held(wh.whitened(df, most=4), rows, 4)
    held(wh.whitened(df), rows, 6)


def test_few_rows(spark):
    def make(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert wh.whitened(make([])).count() == 0
    assert wh.whitened(make([(1, None)])).columns[:3] == ["vec_id", "component", "n"]
    assert wh.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = wh.whitened(make([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two} == {
        (1, 1, 1.0), (2, 1, 1.0)}
    with pytest.raises(ValueError):
        wh.whitened(make([(1, [1.0]), (2, [1.0, 2.0])]))


def test_triangles_are_reduced_in_steps(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(5))]) for i in range(60)]
    held(wh.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")
                     .repartition(9)), rows, 5)


@needs_data
def test_query_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r[0], list(r[1])) for r in df.select("vec_id", "embedding").collect()]
    held(wh.whitened(df), rows, 16)
