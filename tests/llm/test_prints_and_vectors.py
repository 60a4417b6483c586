"""Document fingerprints, delta Lloyd and whitening against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from postmill.llm import imatch, lloyd, whitening
from postmill.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"


def words(text):
    return {w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w}


def prints_by_hand(rows, band, subsets):
    """(id, text) rows, one for each result row."""
    key = lambda r: (r[0] is None, -(r[0] or 0))
    texts = sorted({(i, t or "") for i, t in rows}, key=key)
    df, n, of = Counter(w for _, t in rows for w in words(t or "")), len(rows), imatch.rates(subsets)
    member = lambda w, j: hashlib.md5(f"{w}:{j // 8}".encode()).hexdigest()[j % 8 * 4 :][:4] < f"{65536 // of[j]:04x}"
    inside = {w: [j for j in range(len(of)) if member(w, j)] for w, k in df.items() if k * 2 ** band[0] <= n <= k * 2 ** band[1]}

    def fingerprint(t):
        found = {}
        for w in sorted(words(t)):
            for j in inside.get(w, ()):
                found.setdefault(j, []).append(w)
        md5 = lambda ws: hashlib.md5(" ".join(ws).encode()).hexdigest()
        return "".join(f"{j:02x}{md5(found[j])[:4]}" for j in sorted(found)) or "ff" + md5(sorted(words(t)))

    def near(a, b):
        if a == b or "ff" in (a[:2], b[:2]):
            return float(a == b)
        x, y = ({c[i : i + 6] for i in range(0, len(c), 6)} for c in (a, b))
        return len(x & y) / len({t[:2] for t in x | y})

    out = {}
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = map(fingerprint, (t, edited, following))
        out[i, t] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c))
    return sorted((out[i, t or ""] for i, t in rows), key=str)


@pytest.mark.parametrize("limit", [imatch.BROADCAST_TERMS, 0])
def test_fingerprints_by_hand(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", limit)
    rng = random.Random(5)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(120)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) + rng.choice(["", "\n", " ☃"])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "x"), (104, "Never seen elsewhere"), (105, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, "one without an id w1 w2"), (-7, "w" * 50_000), (2**62, "w5 w6 w7")]
    band, subsets = (0, 9), ((2, 6), (8, 10))
    docs = docs_of(rows, extra=("k", "next", "term", "own_hash", "copies"))
    got = imatch.fingerprints(docs, band=band, subsets=subsets)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=str) == prints_by_hand(rows, band, subsets)
    prints = {}
    for r in found:
        prints.setdefault(r[0], r[3])
    assert prints[105] == prints[3] and len(found) == len(rows)


def test_no_texts_and_one_text(docs_of):
    assert imatch.fingerprints(docs_of([])).count() == 0
    (one,) = imatch.fingerprints(docs_of([(1, "only this text")])).collect()
    assert one.near_edited == 0.0 and one.near_next == 1.0


def test_edits_are_nearer_than_neighbours(spark):
    """Over the shared documents an edited text is nearer than the next one."""
    got = QUERIES["op11_imatch"](spark, "/root/testdata/sf0.01").collect()
    wins = sum(r.near_edited > r.near_next for r in got)
    assert wins >= 0.9 * len(got) and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def lloyd_by_hand(rows, dims, clusters, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((min(dist(x, c), lloyd.LONGEST), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for k in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(x)) for i, x in kept]
    total = Counter()
    for _, d, c in last:
        total[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    held = lambda v: min(v, lloyd.LONGEST)
    return sorted(((i, c, d, held(total[c]), held(sum(total.values())), sha[c]) for i, d, c in last), key=str)


ODD = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, [0.0, 0.0]), (906, [0.0] * 4)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_by_hand(spark, seed):
    rng = random.Random(seed)
    point = lambda: [float(np.float32(rng.gauss(rng.choice([-1, 0, 2]), 0.3))) for _ in range(3)]
    rows = [(i, point()) for i in range(80)] + [(5, point()), (5, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), *[(200 + i, [0.5, 0.5, 0.5]) for i in range(30)], *ODD]
    if seed == 2:
        rows += [(300, [1e5, -1e5, 0.0]), (301, [3e38, 0.0, 0.0])]  # beyond 24 bits, and beyond what is held
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(3).withColumnRenamed("label", "owner").selectExpr("*", "1 as x", "2 as distance")
    got = lloyd.cluster(df, dims=3, clusters=5, rounds=7)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = [(i, [max(min(x, lloyd.MOST / 1024), -lloyd.MOST / 1024) if x is not None and math.isfinite(x) else x for x in v] if v else v) for i, v in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd_by_hand(want, 3, 5, 7, 1024)


def test_few_and_no_vectors(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert lloyd.cluster(make(ODD[:1]), dims=3).count() == 0 == lloyd.cluster(make([]), dims=3).count()
    assert sorted((r.cluster, r.distance) for r in lloyd.cluster(make([(1, [0.0] * 3), (2, [1.0] * 3)]), dims=3).collect()) == [(0, 0), (1, 0)]
    same = lloyd.cluster(make([(i, [0.25] * 3) for i in range(20)]), dims=3).collect()
    assert {r.cluster for r in same} == {0} and same[0].inertia == 0


def test_a_round_reads_only_what_changed():
    """Vectors whose owner stays are compared with the changed centroids alone."""
    x, seen = np.array([[0], [10], [20]]), []
    real = lloyd._distances
    try:
        lloyd._distances = lambda rows, c: seen.append((len(rows), c)) or real(rows, c)
        owner, distance = lloyd.nearest(x, np.array([0, 1, 1], np.int32), np.array([0, 0, 100]), [[0], [10], [19]], {2})
    finally:
        lloyd._distances = real
    assert owner.tolist() == [0, 1, 2] and distance.tolist() == [0, 0, 1] and [n for n, c in seen if c != [19]] == [0, 0]


def whitened_by_hand(rows, scale=64, shift=1_000_000):
    kept = [(i, [math.floor(scale * x) + shift for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    most = Counter(len(x) for _, x in kept)
    d = max(most, key=lambda k: (most[k], k))
    kept = [(i, x) for i, x in kept if len(x) == d]
    n, sums = len(kept), [sum(c) for c in zip(*[x for _, x in kept], strict=True)]
    deviations = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept)
    cov = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept), n**3) for b in range(d)] for a in range(d)]
    return n, d, deviations, cov


def check_whitened(spark, rows, most=32):
    n, d, deviations, cov = whitened_by_hand(rows)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(3).withColumnRenamed("label", "n")
    got = whitening.whiten(df, most=most).collect()
    count = max(r.component for r in got)
    assert {r.n for r in got} == {n} and len(got) == n * count
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == deviations
    explained = [next(r.explained for r in got if r.component == k + 1) for k in range(count)]
    assert explained == sorted(explained, reverse=True) and all(r.identity_error <= 1e-4 for r in got)
    z = np.array([[r.whitened for r in got if r.component == k + 1] for k in range(count)])
    assert np.abs(z @ z.T / n - np.eye(count)).max() <= 1e-4
    trace = sum(cov[a][a] for a in range(d))
    return explained, trace, count, cov


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rng.normal(size=(200, 6)) @ mix)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (500, [1.0] * 5), *ODD]
    explained, trace, count, cov = check_whitened(spark, rows)
    want = np.sort(np.linalg.eigvalsh(np.array(cov, float)))[::-1] / float(trace)
    assert count == 6 and np.allclose(explained, want, rtol=1e-9)
    assert check_whitened(spark, rows, most=3)[2] == 3


def test_whitening_of_uneven_scales(spark):
    """A direction with 10^15 times the variance of another keeps neither from being found."""
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 300))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(zip(a * 4e6, b, a * 4e6 + c * 2e5, strict=True))]
    explained, trace, count, cov = check_whitened(spark, rows)
    # Every eigenvalue is a root of the characteristic polynomial, which changes its sign around it.
    m = lambda t: [[cov[i][j] - (t if i == j else 0) for j in range(3)] for i in range(3)]
    det = lambda q: sum(q[0][i] * (q[1][(i + 1) % 3] * q[2][(i + 2) % 3] - q[1][(i + 2) % 3] * q[2][(i + 1) % 3]) for i in range(3))
    assert count == 3
    for e in explained:
        low, high = (Fraction(e) * trace * Fraction(k, 100_000) for k in (99_999, 100_001))
        assert det(m(low)) * det(m(high)) < 0


def test_whitening_without_spread(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    for rows in ([], ODD[:1], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)]):
        got = whitening.whiten(make(rows))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(make([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 9


def test_limbs_are_exact():
    x = np.array([[-(2**50) - 3, 5], [2**50 - 1, -70_000]], np.int64)
    total = sum(p.astype(object) << (whitening.BITS * k) for k, p in whitening.product(x).items())
    y = x.astype(object)
    assert (total == y.T @ y).all() and all(np.abs(a).max() < 1 << whitening.BITS for a in whitening.limbs(x))
