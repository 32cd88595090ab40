"""Whitening against numpy's eigenvectors, exact integers and hard spectra."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import SF

from caselake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v int, w int, n int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def brute(rows, k=32):
    d = max(len(v) for _, v in rows)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, e, y @ v / np.sqrt(np.where(e > 0, e, 1)), float((y * y).sum() / n)


def held(got, rows, k):
    n, deviation, e, white, trace = brute(rows, k)
    by = {(r["vec_id"], r["component"]): r for r in got}
    kept = max(c for _, c in by)
    assert len(got) == len(rows) * kept
    w = np.array([[by[i, c + 1]["whitened"] for c in range(kept)] for i, _ in rows])
    signs = np.sign((w * white[:, :kept]).sum(axis=0))
    assert np.abs(w - white[:, :kept] * signs).max() < 1e-7
    for r in got:
        assert r["n"] == n and abs(r["explained"] / (e[r["component"] - 1] / trace) - 1) < 1e-6 and r["identity_error"] < 1e-8
    assert [by[i, 1]["deviation"] for i, _ in rows] == deviation
    return kept


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert held(queries.QUERIES["op12_whitening"](spark, SF).collect(), rows, 32) == 32


def op12(df):
    white = whitening.whiten(df)
    from pyspark.sql import functions as F

    return white.select(F.col("id").alias("vec_id"), F.posexplode("w").alias("at", "whitened"), "*").selectExpr("vec_id", "at + 1 as component", "n", "deviation", "whitened", "explained[at] as explained", "identity_error").collect()


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(3000, 2, 4).tolist()) for i in range(30)] + [(30, [1.0, 2.0]), (31, [])]
    bad = [(40, None), (41, [1.0, None, 2.0, 3.0]), (42, [float("nan"), 0.0, 0.0, 0.0]), (43, [0.0, float("inf"), 0.0, 0.0])]
    assert held(op12(vectors_of(spark, good + bad)), good, 32) == 4
    repeated = vectors_of(spark, good * 2 + [(None, [1.0, 0.0, 2.0, 0.0])])
    assert len(op12(repeated)) == (2 * len(good) + 1) * 4


def test_no_variance(spark):
    assert op12(vectors_of(spark, [(1, [1.0, 2.0])] * 5)) == []
    assert op12(vectors_of(spark, [(1, []), (2, None)])) == []
    assert op12(vectors_of(spark, []).where("false")) == []
    flat = op12(vectors_of(spark, [(i, [float(i), 5.0, -float(i)]) for i in range(9)]))
    assert {r["component"] for r in flat} == {1} and len(flat) == 9


def test_same_to_the_last_bit_however_dealt(spark):
    rng = np.random.default_rng(6)
    df = vectors_of(spark, [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-2, 6, 6)).tolist()) for i in range(200)])
    a, b = (whitening.moments(whitening.clean(x, "vec_id", "embedding")) for x in (df.coalesce(1), df.repartition(7)))
    assert a[0] == b[0] and a[1] == b[1] and (a[2] == b[2]).all()


@pytest.mark.parametrize("size", [3, 2**19, 2**25, 2**39])
def test_exact_products(size):
    z = np.random.default_rng(size).integers(-size, size, (50, 5))
    want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening._gram(z).tolist() == want


@pytest.mark.parametrize("spectrum", [np.arange(64.0), [5.0] * 10 + [1.0] * 54, [3.0] * 64, [9.0, 4.0] + [0.0] * 62, 10.0 ** -np.arange(64), 1 + 1e-13 * np.arange(64), [7.0], [2.0, 1.0]])
def test_eigenvectors(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    for a in ((q * np.asarray(spectrum)) @ q.T, np.diag(spectrum)):
        a = (a + a.T) / 2
        k = min(32, d)
        e, v = whitening.eigen(a, k)
        assert np.abs(e - np.sort(spectrum)[::-1][:k]).max() < 1e-13 * max(spectrum) * d
        assert np.abs(a @ v.T - v.T * e).max() < 1e-13 * max(spectrum) * d and np.abs(v @ v.T - np.eye(k)).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal(40), rng.standard_normal(39)
    b[7] = 0.0
    e = np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    at = np.r_[e - 1e-9, e + 1e-9, -9.0, 9.0]
    assert whitening.sturm(a, b, at).tolist() == [int((e < x).sum()) for x in at]
    assert np.abs(whitening.leading(a, b, 40) - e[::-1]).max() < 1e-13
