"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become integers, so sums and deviations are exact.  The fit list holds
each distinct vector once.  Its centred rows are reduced block by block: a QR
factor of each batch, stacked and factored again, first within a partition, then
FAN partitions' factors at a time, until one triangle R (a square of the
dimension) is left.  On the driver Householder reflections make R bidiagonal,
dqds finds its singular values to high relative accuracy, and twisted
factorisations of the bidiagonal's normal matrix give the directions.
Projecting the rows and measuring the whitened covariance run distributed again.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry
are left out; repeated rows each get their result; the fit list counts them once.
Directions whose singular value is lost in rounding (at most the dimension
times 2^-52 of the largest) aren't components, so a fit list of one vector gives
no rows, nor does an empty table.  Vectors of different lengths raise ValueError.
A value, sum or deviation outside 64 bits raises.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_code, stored

SCALE, SHIFT = 64, 1_000_000
#: Triangles that one task of a reduction step stacks.
FAN = 32
EPS = np.finfo(float).eps


# ---- bidiagonal singular values and directions (a square of the dimension) ----

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of the upper bidiagonal Q^T R P, and P."""
    a = np.array(r, float)
    n = len(a)
    p = np.eye(n)

    def reflector(x):
        v, norm = x.copy(), np.linalg.norm(x)
        if norm == 0:
            return None
        v[0] += norm if v[0] >= 0 else -norm
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < n:
            v = reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float):
    """One transform; None if a value turns negative (the shift was too large)."""
    n = len(q)
    qq, ee = np.empty(n), np.empty(max(n - 1, 0))
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        qq[i] = d + e[i]
        if qq[i] == 0:
            ee[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / qq[i]
            ee[i], d = e[i] * t, d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    qq[n - 1] = d
    return qq, ee, least


def singular_values(d: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal, falling, by dqds with shifts."""
    found: list[float] = []
    work = [(np.asarray(d, float) ** 2, np.asarray(f, float) ** 2, 0.0)]
    while work:
        q, e, moved = work.pop()
        least = None
        for step in range(100 * max(len(q), 1) + 1):
            # a superdiagonal below rounding is none
            cut = np.flatnonzero(e <= EPS ** 2 * np.minimum(q[:-1] + moved, q[1:] + moved))
            if len(cut):
                k = cut[-1]
                work += [(q[:k + 1], e[:k], moved), (q[k + 1:], e[k + 1:], moved)]
                break
            if len(q) <= 1:
                found += [v + moved for v in q]
                break
            if step == 100 * len(q):
                raise ArithmeticError("dqds does not converge")
            if q[0] < q[-1] * 0.5 and step % 8 == 0:
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = 0.0 if least is None else least
            for share in (0.98, 0.75, 0.25, 0.0):
                got = _dqds_step(q, e, share * shift)
                if got is not None:
                    q, e, least = got
                    moved += share * shift
                    break
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _twisted(d: np.ndarray, f: np.ndarray, lam: float) -> np.ndarray:
    """The vector of B^T B for ``lam`` from its twisted factorisation: the
    stationary transform from the top and the progressive one from the bottom
    meet where the twisted pivot is smallest."""
    n, tiny = len(d), np.finfo(float).tiny / EPS
    c = d[:-1] * f  # off-diagonal of B^T B
    top, low = np.empty(n), np.empty(n)  # L D L^T from the top: pivots without the shift
    up, down = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s = -lam
    for i in range(n - 1):
        pivot = s + d[i] ** 2
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[i] = c[i] / pivot
        top[i] = s
        s = up[i] * f[i] / d[i] * s - lam if d[i] else f[i] ** 2 - c[i] * up[i] - lam
    top[n - 1] = s
    p = d[n - 1] ** 2 - lam
    for i in range(n - 2, -1, -1):
        pivot = f[i] ** 2 + p
        pivot = pivot if abs(pivot) > tiny else -tiny
        down[i] = c[i] / pivot
        low[i + 1] = p
        p = p / pivot * d[i] ** 2 - lam
    low[0] = p
    gamma = np.abs(top + low + lam)
    k = int(np.argmin(gamma))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def directions(d: np.ndarray, f: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal, a column a value.  Vectors of
    values closer than a thousandth are made orthogonal to one another."""
    n = len(d)
    t = np.diag(d ** 2 + np.append(0, f ** 2)) + np.diag(d[:-1] * f, 1) + np.diag(d[:-1] * f, -1)
    parts = np.split(np.arange(n), np.flatnonzero(
        np.abs(f) <= EPS * np.sqrt(np.abs(d[:-1] * d[1:]))) + 1)
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    owner = []
    for part in parts:  # each unreduced part has its own values
        own = singular_values(d[part], f[part[:-1]]) if len(part) > 1 else np.abs(d[part])
        owner += [(v, part) for v in own]
    owner.sort(key=lambda x: -x[0])
    for j, (v, part) in enumerate(owner[:len(values)]):
        b, c = d[part], f[part[:-1]]
        near = [i for i in range(j) if owner[i][1] is part
                and owner[i][0] - v <= 1e-3 * max(owner[i][0], EPS)]
        z = _twisted(b, c, v * v)
        if near:
            basis = out[part][:, near]
            shifted = t[np.ix_(part, part)] - v * v * np.eye(len(part))
            for _ in range(4):
                z = z - basis @ (basis.T @ z)
                norm = np.linalg.norm(z)
                z = z / norm if norm > 0.5 else rng.standard_normal(len(part))
                if norm > 0.5:
                    break
                try:
                    z = np.linalg.solve(shifted + EPS * v * v * np.eye(len(part)), z)
                except np.linalg.LinAlgError:
                    pass
                z = z / np.linalg.norm(z)
            z = z - basis @ (basis.T @ z)
            z = z / np.linalg.norm(z)
        out[part, j] = z
    return out


def components(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest singular values of R that rounding leaves, and their
    right vectors (columns)."""
    d, f, p = bidiagonal(r)
    s = singular_values(d, f)
    s = s[s > len(s) * EPS * s.max(initial=0)][:most]
    return s, p @ directions(d, f, s)


# ---- distributed steps ----

def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows with finite vectors."""
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(c.isNotNull() & finite).select(
        F.col(f"`{key}`"), F.transform(c, lambda v: (F.floor(v * SCALE) + SHIFT)
                                       .cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.cast(pa.list_(column.type.value_type))
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly (the sum of its squares must fit 64 bits)."""
    far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if far * n >= 1 << 62:
        raise OverflowError("an embedding's value is too large for exact 64-bit deviations")
    out = x * n - sums
    worst = int(np.abs(out).max(initial=0))
    if worst ** 2 * max(x.shape[1], 1) >= 1 << 63:
        small = (out.astype(object) ** 2).sum(1)
        if max(small, default=0) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
    return out


def _flat(a: np.ndarray) -> pa.Array:
    return pa.array([np.ravel(a)], pa.list_(pa.float64()))


def triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred fit list, by QR of batches, partitions and FAN partitions at a time."""
    dim = len(sums)

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, dim))
        for b in blocks:
            r = np.linalg.qr(np.vstack([r, b]), mode="r")
        return r

    def first(batches):
        r = reduced(_deviations(_matrix(b.column(0), dim), n, sums) / n for b in batches)
        yield pa.RecordBatch.from_arrays([_flat(r)], names=["r"])

    def again(batches):
        r = reduced(np.asarray(v.values).reshape(-1, dim) for b in batches for v in b.column(0))
        yield pa.RecordBatch.from_arrays([_flat(r)], names=["r"])

    rs = stored(fit.select("x").mapInArrow(first, "r array<double>"), "triangles")
    count = rs.count()
    while count > 1:
        count = -(-count // FAN)
        rs = stored(rs.repartition(count).mapInArrow(again, "r array<double>"), "triangles")
    r = np.array(rs.first()[0]).reshape(-1, dim)
    return np.vstack([r, np.zeros((max(dim - len(r), 0), dim))])


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
             most: int = 16) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained
    and identity_error."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = integers(vectors, key, vector)
    fit = stored(rows.select("x").distinct(), "fit")
    shape = fit.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"),
                    F.count(F.lit(1)).alias("n")).first()
    n, dim = shape["n"], shape["high"] or 0
    if n and shape["low"] != dim:
        raise ValueError("vectors differ in length")
    schema = T.StructType([rows.schema[0]] + [T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
        ("whitened", T.DoubleType()), ("explained", T.DoubleType()),
        ("identity_error", T.DoubleType()))])
    if not n or not dim:
        return spark.createDataFrame([], schema)

    def added(batches):  # exact: a batch's sums as Python integers
        total = np.zeros(dim, object)
        for b in batches:
            total = total + _matrix(b.column(0), dim).astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(
            [str(v) for v in total])], names=["i", "s"])

    sums = fit.select("x").mapInArrow(added, "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).cast("long").alias("s"))
    sums = np.array([r["s"] for r in sums.orderBy("i").collect()], np.int64)  # one a dimension
    r = triangle(fit, n, sums)
    s, v = components(r, most)
    e = s ** 2 / n
    share = s ** 2 / max((r ** 2).sum(), np.finfo(float).tiny)
    project = v / np.sqrt(e)
    k = len(e)

    def products(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            w = (_deviations(_matrix(b.column(0), dim), n, sums) / n) @ project
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()),
                                          pa.array(total.ravel())], names=["i", "s"])

    total = fit.select("x").mapInArrow(products, "i int, s double").groupBy("i").agg(
        F.sum("s").alias("s")).orderBy("i").collect()  # most * (most + 1) numbers
    total = np.array([t["s"] for t in total]).reshape(k + 1, k) / n
    error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max(initial=0))

    def projected(batches):
        for b in batches:
            x = _deviations(_matrix(b.column(1), dim), n, sums)
            w = (x / n) @ project
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(x) * k, n)), pa.array(np.repeat((x * x).sum(1), k)),
                 pa.array(w.ravel()), pa.array(np.tile(share, len(x))),
                 pa.array(np.full(len(x) * k, error))], names=schema.names)

    return rows.mapInArrow(projected, schema)
