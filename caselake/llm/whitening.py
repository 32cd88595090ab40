"""Embedding whitening by the leading eigenvectors of a distributed covariance.

1. Tasks turn vectors into integers x and sum them by dimension; a second pass centres x at the integers nearest to the
   means and sums the products, in exact integer arithmetic: matrix products of 20-bit limbs, each exact in doubles.
   What is left of the means (less than one half) is taken out exactly, so the covariance is the same to the last bit
   however the rows are dealt.
2. The driver holds only that d x d matrix: Householder reflections make it tridiagonal, Sturm counts bisect to the
   leading eigenvalues, inverse iteration with reorthogonalisation inside clusters finds their vectors, and the
   reflections turn these back.
3. The components (d x 32 numbers at most) are broadcast, and each task projects its own rows.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped; a vector shorter than the
longest counts as if zeros followed; entries beyond 2**40 / 64 count as that; components whose eigenvalue is zero to
double precision have no whitened value and are left out, so one row, equal rows or an empty table give no rows;
repeated ids are rows of their own, null ids pass; deviation is null where it doesn't fit a long; other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries of x - OFFSET beyond this count as this.
MOST = 1 << 40
LIMB = 20
#: Rows whose limb products a matrix product sums: 2**12 * 2**20 * 2**20 fits the 53 bits of a double.
ROWS = 1 << 12


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows whose vector has only finite entries, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)))


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """(rows, d) longs: floor(64 c), zeros behind short vectors."""
    lists = batch.column("v")
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    values = np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)
    sizes = np.diff(offsets)
    z = np.zeros((len(lists), d), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    z[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return z


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(d, dtype=object)
    for batch in batches:
        z = _integers(batch, d)
        n += len(z)
        total = total + z.sum(axis=0)
    if n:
        yield _entries(np.arange(-1, d), np.zeros(d + 1, dtype=np.int64), [n, *total])


def _entries(i: np.ndarray, j: np.ndarray, values: list) -> pa.RecordBatch:
    exact = pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), exact], ["i", "j", "value"])


def _gram(z: np.ndarray) -> np.ndarray:
    """z.T @ z as Python integers."""
    limbs, rest = [], z
    while True:
        top = rest >> LIMB
        if ((top == 0) | (top == -1)).all():
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = top
    total = np.zeros((z.shape[1],) * 2, dtype=object)
    for a, x in enumerate(limbs):
        for b, y in enumerate(limbs):
            total = total + ((x.T @ y).astype(np.int64).astype(object) << (LIMB * (a + b)))
    return total


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    d = len(centre)
    total, seen = np.zeros((d, d), dtype=object), False
    for batch in batches:
        z = _integers(batch, d) - centre
        for at in range(0, len(z), ROWS):
            total, seen = total + _gram(z[at : at + ROWS]), True
    if seen:
        i, j = np.triu_indices(d)
        yield _entries(i, j, total[i, j].tolist())


def _summed(parts: DataFrame) -> list:
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow().to_pylist()


def moments(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums of floor(64 c) by dimension, and the covariance matrix, exact before its entries become doubles."""
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "i int, j int, value decimal(38,0)"
    sums = {r["i"]: int(r["value"]) for r in _summed(rows.select("v").mapInArrow(lambda it: _sums(it, d), schema))}
    n = sums.get(-1, 0)
    if not n or not d:
        return n, [], np.zeros((0, 0))
    total = [sums[k] for k in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    left = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    v = np.zeros((d, d))
    for r in _summed(rows.select("v").mapInArrow(lambda it: _products(it, centre), schema)):
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = float(Fraction(n * int(r["value"]) - left[i] * left[j], n * n))
    return n, total, v


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal and the unit reflectors (each acts on the dimensions after its number)."""
    a, d = a.copy(), len(a)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            reflectors.append(np.zeros(d - k - 1))
            continue
        x[0] += np.copysign(norm, x[0])
        u = x / np.linalg.norm(x)
        reflectors.append(u)
        p = a[k + 1 :, k + 1 :] @ u
        q = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, q) + np.outer(q, u))
        first = a[k + 1 :, k] - 2 * u * (u @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = first
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each number of ``at``: the negative pivots of T - x."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0.0)))
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for a, b in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = (a - at) - b * b / q
        below += q < 0
    return below


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of the Gershgorin interval until no double lies between."""
    d = len(diagonal)
    radius = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    high = high + np.spacing(np.abs(high)) * 4
    want = d - 1 - np.arange(k)  # so many eigenvalues lie below the one looked for
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        below = sturm(diagonal, off, mid) > want
        high, low = np.where(below, mid, high), np.where(below, low, mid)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of zero count as tiny."""
    d = len(diagonal)
    u0, u1, u2, x = diagonal - shift, np.r_[off, 0.0], np.zeros(d), b.copy()
    for i in range(d - 1):
        below = (off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0)
        if abs(below[0]) > abs(u0[i]):
            here = (u0[i], u1[i], u2[i])
            u0[i], u1[i], u2[i] = below
            below = here
            x[i], x[i + 1] = x[i + 1], x[i]
        if u0[i] == 0:
            u0[i] = tiny
        f = below[0] / u0[i]
        u0[i + 1], u1[i + 1] = below[1] - f * u1[i], below[2] - f * u2[i]
        x[i + 1] -= f * x[i]
    if u0[-1] == 0:
        u0[-1] = tiny
    x[-1] /= u0[-1]
    if d > 1:
        x[-2] = (x[-2] - u1[-2] * x[-1]) / u0[-2]
    for i in range(d - 3, -1, -1):
        x[i] = (x[i] - u1[i] * x[i + 1] - u2[i] * x[i + 2]) / u0[i]
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Inverse iteration: a unit vector (row) for each of the falling values. Values closer than a thousandth of the
    norm to the one before make a cluster, in which each vector is kept orthogonal to those before."""
    d = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal))) + 2 * float(np.max(np.abs(off), initial=0.0)), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    found, start, before = np.zeros((len(values), d)), 0, None
    rng = np.random.default_rng(0)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        shift = value if before is None or start == k else min(value, before - 2 * eps * norm)  # equal shifts would give equal vectors
        before = shift
        x = rng.standard_normal(d)
        for _ in range(5):
            x -= found[start:k].T @ (found[start:k] @ x)
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x), eps * norm)
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= found[start:k].T @ (found[start:k] @ x)
                x /= np.linalg.norm(x)
        found[k] = x
    return found


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows, of which the largest
    entry is positive."""
    scale = float(np.max(np.abs(a), initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, len(a)))
    diagonal, off, reflectors = tridiagonal(a / scale)
    values = leading(diagonal, off, k)
    found = vectors_of(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        u = reflectors[at]
        found[:, at + 1 :] -= 2 * np.outer(found[:, at + 1 :] @ u, u)
    found *= np.sign(found[np.arange(k), np.argmax(np.abs(found), axis=1)])[:, None]
    return values * scale, found


def _deviation(z: np.ndarray, n: int, total: list[int]) -> pa.Array:
    reach = n * int(np.abs(z).max(initial=0)) + max(map(abs, total), default=0)
    if reach**2 * max(1, z.shape[1]) < 2**63:
        return pa.array(((n * z - np.array(total, dtype=np.int64)) ** 2).sum(axis=1), pa.int64())
    exact = ((n * z.astype(object) - np.array(total, dtype=object)) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def _project(batches: Iterator[pa.RecordBatch], n: int, total: list[int], shared) -> Iterator[pa.RecordBatch]:
    axes = shared.value  # (d, k), each over the root of its eigenvalue
    d, k = axes.shape
    whole = np.array([s // n for s in total], dtype=np.int64)
    part = np.array([float(Fraction(s % n, n)) for s in total])
    for batch in batches:
        z = _integers(batch, d)
        w = ((z - whole) - part) @ axes
        offsets = pa.array(np.arange(0, len(z) * k + 1, k), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), _deviation(z, n, total), lists], ["id", "deviation", "w"])


def _identity(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    gram = np.zeros((k + 1, k + 1))
    for batch in batches:
        w = batch.column("w").values.to_numpy().reshape(-1, k)
        w = np.c_[w, np.ones(len(w))]
        gram += w.T @ w
    i, j = np.indices(gram.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(gram.ravel())], ["i", "j", "value"])


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, deviation, w (a whitened value for each component), n, explained (by component), identity_error."""
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    n, total, v = moments(rows)
    values, axes = eigen(v, min(components, len(v)))
    trace = float(np.trace(v))
    kept = int((values > len(v) * np.finfo(float).eps * trace).sum()) if len(values) else 0
    id_type = dict(rows.dtypes)["id"]
    if not kept:
        return spark.createDataFrame([], f"id {id_type}, deviation long, w array<double>, n long, explained array<double>, identity_error double")
    values, axes = values[:kept], axes[:kept]
    shared = spark.sparkContext.broadcast((axes / np.sqrt(values)[:, None]).T.copy())
    projected = table(rows.mapInArrow(lambda it: _project(it, n, total, shared), f"id {id_type}, deviation long, w array<double>"), "whitened")
    gram = np.zeros((kept + 1, kept + 1))
    for r in _summed(projected.select("w").mapInArrow(lambda it: _identity(it, kept), "i int, j int, value double")):
        gram[r["i"], r["j"]] = r["value"] / n
    mean = gram[kept, :kept]
    error = float(np.abs(gram[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())
    return projected.select("id", "deviation", "w", F.lit(n).cast("long").alias("n"), F.lit((values / trace).tolist()).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = white.select("*", F.posexplode("w").alias("at", "whitened"))
    return each.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
