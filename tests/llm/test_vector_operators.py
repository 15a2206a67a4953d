"""Clustering and whitening of embeddings against plain versions."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from kithgraph.llm import orchard, whitening
from kithgraph.llm.orchard import Centroids, search

NAN, INF = float("nan"), float("inf")


def plain_clusters(rows, k, rounds, size, seed=1, scale=64):
    def key(row):
        return (row[0] is None, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    kept = [r for r in rows if r[1] is not None and len(r[1]) == size and all(x is not None and math.isfinite(x) for x in r[1])]
    own = [[math.floor(scale * x) for x in v] for _, v in kept]
    centroids = [[math.floor(scale * x) for x in v] for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for v in own:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else c for i, c in enumerate(centroids)]
    found = [nearest(v) for v in own]
    total = {i: sum(d for d, j in found if j == i) for _, i in found}
    return sorted(((r[0] is None, r[0] or 0), i, d, total[i], sum(total.values())) for r, (d, i) in zip(kept, found, strict=True)), centroids


SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, n string"
ODD = [(0, None), (1, []), (2, [1.0, None, 0.0]), (3, [NAN, 0.0, 0.0]), (4, [INF, 0.0, 0.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0, 4.0])]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "y", "z") for row in rows], SCHEMA)


@pytest.mark.parametrize("count", [3, 200])
def test_clusters_with_ties_repeats_and_rows_without_place(spark, count):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-3, 4, 3) / 64).tolist()) for i in range(count)]
    rows = rows + rows[: count // 3] + [(None, [0.5, 0.5, 0.5])] + ODD
    found, centroids = orchard.cluster(frame(spark, rows), k=6, rounds=3, size=3)
    got = sorted(((r.vec_id is None, r.vec_id or 0), *r[1:]) for r in found.collect())
    assert (got, centroids) == plain_clusters(rows, 6, 3, 3)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i * 3**12), -float(i % 3) * 2**22, 1.5]) for i in range(8)]
    found, centroids = orchard.cluster(frame(spark, rows), k=2, rounds=2, size=3)
    got = sorted(((False, r.vec_id), *r[1:]) for r in found.collect())
    assert (got, centroids) == plain_clusters(rows, 2, 2, 3)


def test_no_vectors(spark):
    none = frame(spark, ODD)
    assert orchard.cluster(none, size=3)[0].count() == orchard.cluster(none.limit(0))[0].count() == 0
    assert whitening.whiten(none.filter("vec_id < 5")).filter("vec_id > 2").count() == whitening.whiten(none.limit(0)).count() == 0


def test_the_walk_measures_fewer_distances_and_finds_the_same():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (40, 8))
    points = np.repeat(centres, 30, axis=0) + rng.integers(-9, 10, (1200, 8))
    found, close, measured = search(points, Centroids(centres.tolist()))
    apart = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (found == apart.argmin(axis=1)).all() and (close == apart.min(axis=1)).all()
    assert measured < apart.size / 2


def plain_whitening(rows, scale=64):
    x = np.floor(scale * np.array([v for _, v in rows])) + 1_000_000
    z = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(z.T @ z / len(x))
    return z, values[::-1], axes[:, ::-1]


def test_whitening_of_repeated_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * [1, 3, 0.2] + [5, -7, 1e4]).tolist()) for i in range(60)]
    rows += rows[:20] + [(None, rows[0][1])]
    got = whitening.whiten(frame(spark, rows + ODD), most=2).collect()
    z, values, axes = plain_whitening(rows)
    assert len(got) == len(rows) and {r.n for r in got} == {len(rows)}
    want = {row[0]: (z[i] @ axes[:, :2] / np.sqrt(values[:2]), math.floor(sum((len(rows) * z[i]) ** 2) + 0.5)) for i, row in enumerate(rows)}
    signs = None
    for r in got:
        white, apart = want[r.vec_id]
        assert abs(int(r.deviation) - apart) <= 1e-6 * apart
        signs = np.sign(white * r.whitened) if signs is None else signs
        assert np.allclose(np.array(r.whitened) * signs, white, atol=1e-8)
        assert np.allclose(r.explained, values[:2] / values.sum(), rtol=1e-12) and r.identity_error < 1e-12


def test_deviation_is_exact(spark):
    rows = [(i, [i / 64, -i * i / 64, 12345.0]) for i in range(50)]
    own = [[math.floor(64 * x) for x in v] for _, v in rows]
    sums = [sum(x) for x in zip(*own, strict=True)]
    want = {i: sum((50 * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for i, v in enumerate(own)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, rows)).collect()} == want


def test_fewer_components_than_dimensions_and_equal_variances(spark):
    box = [(i, [x, y, z, x]) for i, (x, y, z) in enumerate((x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0))]
    got = whitening.whiten(spark.createDataFrame(box, "vec_id long, embedding array<float>")).collect()
    assert got[0].explained == pytest.approx([0.5, 0.25, 0.25]) and got[0].identity_error < 1e-12
    white = np.array([r.whitened for r in got])
    assert np.allclose(white.T @ white / 8, np.eye(3), atol=1e-12)
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, int(r.deviation)) for r in same] == [([], [], 0)] * 3


def determinant(rows):
    rows, out = [[Fraction(x) for x in r] for r in rows], Fraction(1)
    for k in range(len(rows)):
        pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            rows[k], rows[pivot], out = rows[pivot], rows[k], -out
        out *= rows[k][k]
        for i in range(k + 1, len(rows)):
            f = rows[i][k] / rows[k][k]
            rows[i] = [a - f * b for a, b in zip(rows[i], rows[k], strict=True)]
    return out


def test_polynomial_equals_the_determinant_at_more_points_than_its_degree(spark):
    rng = np.random.default_rng(11)
    half = rng.integers(-10**6, 10**6, (6, 5)).astype(object)
    matrix = (half @ half.T).tolist()
    poly, distinct = whitening.characteristic_polynomial(spark, matrix)
    assert distinct == 6 and poly[0] == 0
    for x in range(-3, 5):
        assert sum(c * x**k for k, c in enumerate(poly)) == determinant([[x * (i == j) - v for j, v in enumerate(row)] for i, row in enumerate(matrix)])


def product(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    return poly


def test_roots_are_isolated_with_their_times_however_close():
    bits, found = whitening.isolate(product([0, 0, 3, 10**30, 10**30 + 1, 7, 7, 7]), 5)
    assert [(round(Fraction(place + 1, 1 << bits)), times) for place, times in found] == [(10**30 + 1, 1), (10**30, 1), (7, 3), (3, 1)]
    assert whitening.roots_above(product([1, 2, 2, 9]), 2) == 1 and whitening.roots_above(product([1, 2, 2, 9]), 1) == 3


def test_components_of_close_roots_are_told_apart(spark):
    matrix = [[10**12 + 1, 1, 0], [1, 10**12, 0], [0, 0, 5]]
    found = whitening.components(spark, matrix, 3)
    plane = [math.atan2(v[1], v[0]) for _, _, v in found[:2]]
    want = 0.5 * math.atan2(2, 1)
    assert min(abs(abs(plane[0]) - want), abs(abs(plane[0]) - (math.pi - want))) < 1e-12
    assert abs(np.dot(found[0][2], found[1][2])) < 1e-15 and abs(abs(found[2][2][2]) - 1) < 1e-15


def test_query_whitens_its_own_table(spark):
    import conftest

    rows = whitening.op13_embedding_whitening(spark, conftest.DATA).toPandas()
    n = rows.n[0]
    assert len(rows) == 32 * n and set(rows.component) == set(range(1, 33))
    white = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    error = np.abs(white.T @ white / n - np.eye(32)).max()
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-12 and error < 1e-12
    vectors = spark.read.parquet(f"{conftest.DATA}/embeddings.parquet").orderBy("vec_id").collect()
    _, values, _ = plain_whitening([(r.vec_id, r.embedding) for r in vectors])
    assert np.allclose(rows.drop_duplicates("component").sort_values("component").explained, values[:32] / values.sum(), rtol=1e-10)
