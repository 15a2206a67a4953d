"""Pruned joins, inverted files and exact ranks against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kithgraph.operators import cells, greedy, simjoin, tables


def groups(n, middles, spread, seed=2, dim=24):
    """Vectors around a few directions, with copies, in no order."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(middles, dim))[rng.integers(0, middles, n)]
    v = v / np.linalg.norm(v, axis=1, keepdims=True) + spread * rng.normal(size=(n, dim))
    v[: n // 10] = v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, shift=0):
    return spark.createDataFrame([(i + shift, row.tolist()) for i, row in enumerate(v)], "id long, vector array<double>")


@pytest.mark.parametrize(("spread", "least"), [(0.02, 0.9), (0.2, 0.5), (0.02, -0.2)])
def test_pruned_join_equals_all_pairs(spark, spread, least):
    a, b = groups(300, 6, spread), groups(220, 6, spread, seed=3) * 1.5
    got = {(r.id_a, r.id_b): r.sim for r in simjoin.similarity_join(frame(spark, a), frame(spark, b), least, rows=32).collect()}
    sims = np.clip(a @ b.T, -1, 1)
    assert got == {(i, j): pytest.approx(sims[i, j], abs=1e-6) for i, j in zip(*np.nonzero(sims >= least), strict=True)}


def test_only_near_blocks_meet_and_copies_do_not_grow_with_the_table(spark):
    copies = {}
    for n in (400, 1600):
        met = cells.Meeting(frame(spark, groups(n, 12, 0.01)), rows=n // 20)
        pairs, blocks = met.pairs(0.9).count(), met.a.blocks
        assert met.pairs().count() == blocks**2 and pairs < 0.25 * blocks**2
        copies[n] = pairs / blocks
        assert met.a.spans.agg(F.max("n")).first()[0] <= 2 * (n // 20)
    assert copies[1600] < 1.6 * copies[400]


def test_copies_of_one_vector_are_cut_into_blocks(spark):
    v = np.tile(groups(1, 1, 0), (500, 1))
    met = cells.Meeting(frame(spark, v), rows=40)
    assert met.a.blocks >= 12 and met.a.spans.agg(F.max("n")).first()[0] <= 80
    assert simjoin.similarity_join(frame(spark, v), frame(spark, v), 0.99, rows=200).count() == 250_000


def test_bounds_hold_for_every_pair_of_blocks(spark):
    a = groups(400, 5, 0.3) * np.linspace(0.5, 2, 400)[:, None]
    met = cells.Meeting(frame(spark, a), rows=32)
    block = {r.id: r["_block"] for r in met.a.table.select("id", "_block").collect()}
    bounds = {(r.a_block, r.b_block): (r.least, r.most) for r in met.pairs().collect()}
    for i, j in np.random.default_rng(1).integers(0, 400, (3000, 2)):
        low, high = bounds[block[i], block[j]]
        assert low <= a[i] @ a[j] <= high


def test_nearest_neighbours_with_and_without_enough_rows(spark):
    a, b = groups(150, 6, 0.1), groups(260, 6, 0.1, seed=5)
    for k, rows in ((5, 48), (300, 128)):
        got = {(r.id_a, r["rank"]): r.id_b for r in simjoin.knn(frame(spark, a), frame(spark, b, 1000), k, rows=rows).collect()}
        sims = np.round(np.clip(a @ b.T, -1, 1), 6)
        want = {(i, n + 1): 1000 + j for i in range(150) for n, j in enumerate(sorted(range(260), key=lambda j: (-sims[i, j], j))[:k])}
        assert got == want


def test_vectors_that_are_null_or_absent(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, vector array<double>")
    assert sorted(map(tuple, simjoin.similarity_join(some, some, 0.5).collect())) == [(1, 1, 1.0)]
    assert simjoin.knn(some.filter("id > 9"), some, 2).count() == simjoin.similarity_join(some, some.filter("id > 9"), 0.1).count() == 0
    assert simjoin.ann_join(some.filter("id > 9"), None, 0.5)[0].count() == 0


def test_inverted_file_finds_nine_in_ten_and_looks_at_few(spark):
    v = groups(900, 30, 0.12)
    near = np.triu(v @ v.T >= 0.7, 1)
    for rows in (4096, 40):
        found, looked = simjoin.ann_join(frame(spark, v), None, 0.7, rows=rows)
        got = {(r.id_a, r.id_b) for r in found.collect()}
        assert all(near[i, j] for i, j in got) and len(got) >= 0.9 * near.sum()
        assert looked < 0.3
    low = simjoin.fit_inverted_file(frame(spark, v), 0.7, 0.5).probes
    assert low < simjoin.fit_inverted_file(frame(spark, v), 0.7, 1.0).probes


@pytest.mark.parametrize("kind", ["ties", "skew", "even"])
def test_parts_of_an_order_are_bounded_and_totals_exact(spark, kind):
    rng = np.random.default_rng(6)
    at = {"ties": np.where(rng.random(3000) < 0.9, 7, rng.integers(0, 50, 3000)), "skew": (rng.pareto(0.5, 3000) * 10).astype(np.int64), "even": np.arange(3000)}[kind]
    rows = [(int(t), int(i), int(i % 3)) for t, i in zip(at, rng.permutation(3000), strict=True)]
    df = spark.createDataFrame(rows, "at long, id long, w long")
    sizes = [r["count"] for r in tables.in_parts(df, ["at", "id"], 100).groupBy("_part").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 3000
    got = {r.id: r.total for r in tables.running_total(df, ["at", "id"], F.col("w"), "total", 100).collect()}
    want, total = {}, 0
    for _, i, w in sorted(rows):
        total += w
        want[i] = total
    assert got == want


def test_tiles_of_a_block_hold_few_similarities_at_a_time(monkeypatch):
    monkeypatch.setattr(cells, "TILE_CELLS", 40)
    v = groups(10, 3, 0.2)
    x = pd.DataFrame({"id": range(10), "vector": list(v)})
    parts = list(cells.tiles(x, x))
    assert max(sims.size for _, sims in parts) <= 40 and np.allclose(np.concatenate([sims for _, sims in parts]), np.clip(v @ v.T, -1, 1))


def test_few_rows_of_each_task_reach_the_sort_of_a_sample(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE_ROWS", 20)
    df = frame(spark, groups(4000, 3, 0.2))
    hashes = df.select("id", F.xxhash64("id").alias("h")).toPandas().sort_values("h")
    found = cells.sampled(df, 4000)
    assert {r.id for r in found.collect()} == set(hashes.id[:20])
    # All rows did before.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Filter") and df.filter(F.xxhash64("id") < int(2**64 * 40 / 4000) - 2**63).count() < 100


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 4)
    met = cells.Meeting(frame(spark, groups(600, 3, 0.2)))
    # 150 blocks of four rows before.
    assert met.a.blocks < 60


def test_own_pairs_degrees_and_links_of_blocks(spark):
    v = groups(160, 8, 0.1)
    df, near = frame(spark, v), np.clip(v @ v.T, -1, 1) >= 0.7
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if near[i, j]}
    got = [(r.id_a, r.id_b) for r in simjoin.similar_pairs(df, 0.7, rows=24).collect()]
    assert set(got) == want and len(got) == len(want)
    degree = near.sum(axis=1) - 1
    assert {r.id: r.degree for r in simjoin.similar_counts(df, 0.7).collect()} == {i: degree[i] for i in range(160) if degree[i]}
    edges = greedy.near_edges(df, 0.7).collect()
    top = list(range(160))
    for _ in range(160):
        for r in edges:
            top[r.a] = top[r.b] = min(top[r.a], top[r.b])
    whole = list(range(160))
    for _ in range(160):
        for i, j in want:
            whole[i] = whole[j] = min(whole[i], whole[j])
    assert top == whole and len(edges) <= 4 * 160 < len(want)


def test_probes_of_a_search_count_on_the_asking_side_only(spark):
    v = groups(600, 40, 0.3)
    base, asked = frame(spark, v), frame(spark, v[:60])
    one, both = (simjoin.fit_inverted_file(base, 0.5, 0.95, side) for side in (False, True))
    assert one.probes > both.probes
    near = set(zip(*np.nonzero(v[:60] @ v.T >= 0.5), strict=True))
    found = {(r.id_a, r.id_b) for r in simjoin.ann_join(asked, base, 0.5)[0].collect()}
    assert len(found & near) >= 0.9 * len(near)


def test_candidates_are_scored_on_a_grid_without_a_row_for_each(spark, monkeypatch):
    from kithgraph.operators import matching

    monkeypatch.setattr(matching, "GRID_VALUES", 8 * 20)
    monkeypatch.setattr(matching, "GRID_FACES", 16)
    rng = np.random.default_rng(4)
    v, w = unit_rows(rng, 60), unit_rows(rng, 70)
    faces = [(i, v[i].tolist(), None if i == 7 else 35 + i, None if i == 8 else i // 3) for i in range(60)]
    reps = [(100 + i // 3, w[i].tolist(), None if i == 5 else i // 3) for i in range(70)]
    near = [(i, 100 + int(c), n + 1, float(0.5 - n / 100)) for i in range(60) for n, c in enumerate(rng.permutation(30)[:28])]
    want = {}
    for i, c, rank, middle in near:
        own = [(x, at) for at, x in enumerate(reps) if x[0] == c and x[2] is not None]
        sims = [round(min(1, max(-1, float(v[i] @ w[at]) + min(0.08, max(-0.08, (faces[i][2] / 100 - 0.5) * 0.2)))), 6) for x, at in own if None not in faces[i] and x[2] != faces[i][3]]
        sim = middle if not own else max(sims, default=None)
        at = want.setdefault((i, "a" if rank <= matching.CANDIDATES else "b"), [0, None])
        at[0] += 1
        if sim is not None and sim > 0 and (at[1] is None or (-sim, rank) < at[1][:2]):
            at[1] = (-sim, rank, c)
    got = matching.scored_candidates(
        spark.createDataFrame(near, "face_id long, cluster_id long, rank int, middle double"),
        spark.createDataFrame(faces, "face_id long, v array<double>, quality_score int, photo_id long"),
        spark.createDataFrame(reps, "cluster_id long, w array<double>, rep_photo long"),
    ).collect()
    assert len(got) < len(near) / 3
    found = {}
    for r in got:
        at = found.setdefault((r.face_id, r["where"]), [0, None])
        at[0] += r.n
        if r.sim is not None and (at[1] is None or (-r.sim, r.rank) < at[1][:2]):
            at[1] = (-r.sim, r.rank, r.cluster_id)
    assert found == want


def unit_rows(rng, n, width=8):
    x = rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_block_meets_neighbouring_blocks_as_one(spark):
    rows = unit_rows(np.random.default_rng(6), 900)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>")
    met = cells.Meeting(table, table.filter("id % 2 = 0"), rows=20)

    def sizes(x, y, _):
        return pd.DataFrame({"a": [x["_block"].iloc[0]], "cells": [len(x) * len(y)]})

    got = {name: met.fold(sizes, "a long, cells long", met.pairs(), blocks=True, bundled=name).collect() for name in (False, True)}
    assert met.b.blocks > 10 and len(got[True]) <= 2 * met.a.blocks < len(got[False])
    assert sum(r.cells for r in got[True]) == sum(r.cells for r in got[False]) == 900 * 450


@pytest.mark.parametrize("supporting", [0.35, 0.0, -1.0, 1.1])
def test_the_least_supporting_similarity_stands_for_moved_and_rounded_ones(supporting):
    from kithgraph.operators import matching

    rng = np.random.default_rng(8)
    boost = np.append(rng.uniform(-0.08, 0.08, 40), [0, 0.08, -0.08, np.nan])
    least = matching.least_supporting(boost, supporting)
    sims = np.concatenate([rng.uniform(-1, 1, (len(boost), 50)), np.clip(supporting - boost[:, None] - 5e-7 + rng.normal(0, 1e-9, (len(boost), 50)), -1, 1), least[:, None], np.nextafter(least, -9)[:, None]], axis=1)
    sims = np.clip(sims, -1, 1)
    assert ((sims >= least[:, None]) == (np.round(np.clip(sims + boost[:, None], -1, 1), 6) >= supporting))[:-1].all()
    assert not (sims[-1] >= least[-1]).any()
