"""Centroid clustering by delta Lloyd (operator 12).

Vectors are turned into integers, so sums and distances are exact and the same in any order. Each vector's owner and its
distance are kept in a table of the shared folder beside the vector, and the sums of all clusters on the driver (clusters x dimensions). A round compares
a vector with the changed centroids only; one whose own centroid changed is compared with all. Then only vectors whose owner
moved are read: each adds its components to one cluster and takes them from another, as signed integers summed by Spark. Where no centroid changes, the
rounds that are left would change nothing and are left out.

Defined results: a vector is kept if it has exactly ``dims`` components, none null or non-finite. Fewer kept vectors than clusters give fewer clusters; none give no
rows. Repeated ids are separate vectors, in the order of their components where a start is chosen; an id that is null counts as the text ``null`` there.
Scaled components are held to +-2^31 and distances, so computed on Python's integers, to the greatest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.session import discard, saved

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
LONGEST, MOST = 2**63 - 1, 2**31
#: Components below this have squared distances of less than 63 bits in up to 4,096 dimensions.
SAFE = 2**24


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """(id, x) of the kept vectors."""
    e = F.col(vector_col).cast("array<double>")
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST))))
    return vectors.where((F.size(e) == dims) & ~odd).select(F.col(id_col).alias("id"), F.transform(e, held).alias("x"))


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    return [list(r.x) for r in rows.orderBy(order, "x").select("x").limit(clusters).collect()]


def _distances(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    diff = x - np.array(centroid, dtype=x.dtype)
    return (diff * diff).sum(axis=1)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: list[list[int]], changed: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the changed centroids moved; an owner of -1 has none yet."""
    lost = (owner < 0) | np.isin(owner, list(changed))
    best, at = distance.copy(), owner.copy()
    at[lost] = len(centroids)  # beyond every number, at a distance beyond every other
    best[lost] = LONGEST
    for c, centre in enumerate(centroids):
        rows = np.arange(len(x)) if c in changed else np.flatnonzero(lost)
        d = _distances(x[rows], centre)
        d = np.minimum(d, LONGEST).astype(np.int64) if d.dtype == object else d
        better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], c
    return at, best


def assign(state: DataFrame, centroids: list[list[int]], changed: set[int]) -> DataFrame:
    """state (id, x, owner, distance) with new owners and distances, and ``was``, the owner before."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if max(np.abs(x).max(), max(abs(v) for c in centroids for v in c)) >= SAFE:
                x = x.astype(object)
            was = b.column("owner").to_numpy(zero_copy_only=False)
            owner, distance = nearest(x, was, b.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(was)], ["id", "x", "owner", "distance", "was"])

    kind = dict(state.dtypes)["id"]
    return state.select("id", "x", "owner", "distance").mapInArrow(f, f"id {kind}, x array<bigint>, owner int, distance bigint, was int")


def transfers(state: DataFrame) -> dict[int, list[int]]:
    """What vectors whose owner moved add to the sums of the clusters: for each cluster one number a dimension, and the count last."""
    moved = state.where("owner <> was").select("owner", "was", F.posexplode(F.concat("x", F.array(F.lit(1).cast("bigint")))).alias("dim", "value"))
    signed = moved.select("dim", F.explode(F.array(F.struct(F.col("owner").alias("cluster"), F.col("value")), F.struct(F.col("was").alias("cluster"), (-F.col("value")).alias("value")))).alias("t"))
    sums = signed.where("t.cluster >= 0").groupBy("t.cluster", "dim").agg(F.sum(F.col("t.value").cast("decimal(20,0)")).alias("value"))
    out: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # clusters x dimensions
        out.setdefault(r.cluster, {})[r.dim] = int(r.value)
    return {c: [v[d] for d in sorted(v)] for c, v in out.items()}


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """The last state and the centroids it is of. rows: (id, x), written, as they are read twice."""
    centroids = starts(rows, clusters, seed)
    none = F.lit(-1).alias("owner"), F.lit(0).cast("bigint").alias("distance")
    state, changed = rows.select("id", "x", *none), set(range(len(centroids)))
    if not centroids:
        return state, centroids
    sums = [[0] * (len(centroids[0]) + 1) for _ in centroids]
    for k in range(rounds + 1):
        new = saved(assign(state, centroids, changed), "lloyd")
        if k:
            discard(state)
        state = new
        if k == rounds:
            break
        for c, delta in transfers(state).items():
            sums[c] = [a + b for a, b in zip(sums[c], delta, strict=True)]
        after = [[v // s[-1] for v in s[:-1]] if s[-1] else old for s, old in zip(sums, centroids, strict=True)]
        changed = {c for c, (a, b) in enumerate(zip(after, centroids, strict=True)) if a != b}
        centroids = after
        if not changed:
            break
    return state, centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    rows = saved(integers(vectors, id_col, vector_col, scale, dims), "integers")
    state, centroids = fit(rows, clusters, rounds, seed)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.owner: int(r.t) for r in state.groupBy("owner").agg(total.alias("t")).collect()}  # a row for each cluster
    held = lambda v: F.lit(min(v, LONGEST)).cast("bigint")
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.get(F.array(*values), F.col("owner")) if values else F.lit(None)
    return state.select(
        F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance", of([held(inertia.get(c, 0)) for c in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        held(sum(inertia.values())).alias("inertia"), of([F.lit(t) for t in texts]).cast("string").alias("centroid_sha256"),
    )
