"""Embedding whitening by digit-slice products (operator 13).

Entries become large integers, whose covariance in floating point would lose its digits to cancellation. Each task splits its vectors into
limbs of 16 bits; products of limb matrices by float64 BLAS are exact, as no sum of them reaches 2^53; limbs are recombined as Python's integers and merged by Spark in decimals.
So n, S and the sum of x x' are exact, and the covariance is rounded once. Its eigenvectors come from LAPACK, then from Jacobi rotations
in extended precision, which keep small eigenvalues accurate beside large ones. Whitened rows are made from n x - S, exact, and their own covariance is
summed over all rows.

Only matrices of dimensions x dimensions go to the driver. Defined results: a row is dropped whose vector is null or holds null or
non-finite entries, and one of another length than most have (the longer of two as common lengths), empty ones always. There are as many components, at most ``most``, as eigenvalues
above zero within rounding: none where all vectors are equal, and none of an empty table, and no rows then. Entries are held to +-2^50 after scaling.
A deviation of more than 64 bits is a decimal in ``whiten`` and an error where it is cast to a long. Repeated rows and null ids count each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BITS = 16
#: Rows of a block: 2^20 products of two limbs stay below 2^53.
ROWS = 1 << 20
#: Blocks until the 64-bit sums are moved to Python's integers.
BLOCKS = 1 << 10
#: Integers travel as two decimals: those beyond, and those below, this.
BASE = 10**18
HELD = float(2**50)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the rows that remain."""
    e = F.col(vector_col).cast("array<double>")
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(HELD)), F.lit(-HELD))) + shift
    rows = vectors.where(e.isNotNull() & ~odd & (F.size(e) > 0)).select(F.col(id_col).alias("id"), F.transform(e, held).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as the sum of limb_k 2^(16 k): all but the last are in [0, 2^16), the last one is signed."""
    out = []
    while x.size and np.abs(x).max() >= 1 << BITS:
        out.append((x & ((1 << BITS) - 1)).astype(np.float64))
        x = x >> BITS
    return [*out, x.astype(np.float64)]


def product(x: np.ndarray) -> dict[int, np.ndarray]:
    """x' x by powers of 2^16: exact float64 products of limbs, as 64-bit integers."""
    parts, out = limbs(x), {}
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            p = (a.T @ b).astype(np.int64)
            out[i + j] = out[i + j] + p if i + j in out else p
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for k in range(0, len(x), ROWS):
                yield x[k : k + ROWS]


def moments(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of all dimensions, and the sums of all products of two, exact."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, held, seen = 0, None, {}, 0
        for x in _blocks(batches):
            if total is None:
                total = np.zeros((x.shape[1] + 1, x.shape[1]), object)
            n += len(x)
            total[-1] += x.sum(axis=0, dtype=object) if np.abs(x).max() >= 1 << 42 else x.sum(axis=0).astype(object)
            for power, p in product(x).items():
                held[power] = held[power] + p if power in held else p
            seen += 1
            if seen % BLOCKS == 0:
                for power, p in held.items():
                    total[:-1] += p.astype(object) << (BITS * power)
                held = {}
        if total is None:
            return
        for power, p in held.items():
            total[:-1] += p.astype(object) << (BITS * power)
        d = total.shape[1]
        told = [(-1, -1, n), *[(-1, j, total[-1, j]) for j in range(d)], *[(i, j, total[i, j]) for i in range(d) for j in range(i, d)]]
        big, small = pa.decimal128(38, 0), pa.decimal128(38, 0)
        parts = [divmod(int(v), BASE) for _, _, v in told]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in told], pa.int32()), pa.array([j for _, j, _ in told], pa.int32()), pa.array([Decimal(a) for a, _ in parts], big), pa.array([Decimal(b) for _, b in parts], small)], ["i", "j", "high", "low"]
        )

    found = rows.select("x").mapInArrow(f, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    value = {(r.i, r.j): int(r.high) * BASE + int(r.low) for r in found.collect()}  # dimensions x dimensions
    d = sum(1 for i, j in value if i == -1 and j >= 0)
    return value.get((-1, -1), 0), [value[-1, j] for j in range(d)], [[value[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """(n P - S S') / n^2, rounded once to extended precision."""

    def rounded(v: int) -> np.longdouble:
        exact = Fraction(v, n * n)
        high = float(exact)
        return np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))

    d = len(sums)
    out = np.zeros((d, d), np.longdouble)
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = rounded(n * products[i][j] - sums[i] * sums[j])
    return out


def _orthonormal(q: np.ndarray) -> np.ndarray:
    """Gram-Schmidt, twice, in q's own precision."""
    q = q.copy()
    for _ in range(2):
        for k in range(q.shape[1]):
            q[:, k] -= q[:, :k] @ (q[:, :k].T @ q[:, k])
            q[:, k] /= np.sqrt(q[:, k] @ q[:, k])
    return q


def eigen(v: np.ndarray, sweeps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors, as columns, of a symmetric matrix."""
    eps = np.finfo(np.longdouble).eps
    q = _orthonormal(np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble))
    b = q.T @ v @ q
    for _ in range(sweeps):
        turned = False
        for i in range(len(b)):
            for j in range(i + 1, len(b)):
                if abs(b[i, j]) <= 4 * eps * np.sqrt(abs(b[i, i] * b[j, j])) or b[i, j] == 0:
                    continue
                turned = True
                theta = (b[j, j] - b[i, i]) / (2 * b[i, j])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                b[:, [i, j]] = b[:, [i, j]] @ turn
                b[[i, j], :] = turn.T @ b[[i, j], :]
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(b), kind="stable")
    return np.diag(b)[order], q[:, order]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where it fits, else as Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int]:
    small = y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63
    y = y if small else y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, most: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: n, deviation, whitened, explained, identity_error."""
    rows = integers(vectors, id_col, vector_col, scale, shift)
    n, sums, products = moments(rows)
    values, basis = np.zeros(0), np.zeros((len(sums), 0))
    if n:
        values, basis = eigen(covariance(n, sums, products))
    floor = len(sums) * 16 * np.finfo(np.longdouble).eps * (values[0] if len(values) else 0)
    kept = int(min(most, (values > floor).sum()))
    trace = values.sum()
    weights = (basis[:, :kept] / np.sqrt(values[:kept])).astype(np.float64)
    explained = [float(v / trace) for v in values[:kept]]

    def project(y: np.ndarray) -> np.ndarray:
        return (y / n).astype(np.float64) @ weights

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept))
        for x in _blocks(batches):
            z = project(centred(x, n, sums))
            total += z.T @ z
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(sums)), np.int64)
            y = centred(x, n, sums)
            z = project(y) if b.num_rows else np.zeros((0, kept))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(kept, 1), np.int32)[: len(z) + 1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([Decimal(v) for v in deviations(y)], pa.decimal128(38, 0)), lists], ["id", "deviation", "z"])

    kind = dict(rows.dtypes)["id"]
    if not kept:
        return rows.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    found = rows.select("x").mapInArrow(squares, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # components x components
    error = max(abs(r.v / n - (r.i == r.j)) for r in found)
    out = rows.mapInArrow(f, f"id {kind}, deviation decimal(38,0), z array<double>").select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)), F.col("at"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
