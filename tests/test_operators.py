import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kithgraph.functions import scoring, vectors
from kithgraph.operators import clustering, matching, people, sequence, simjoin, tables
from kithgraph.operators.graph import components
from kithgraph.streaming import jobs


def test_upsert_takes_the_last_row_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, at long")
    new = spark.createDataFrame([(2, "c", 2), (2, None, 3), (3, "d", 1)], old.schema)
    once = tables.upsert(old, new, "id", "at")
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a", 1), (2, None, 3), (3, "d", 1)]
    assert sorted(map(tuple, tables.upsert(once, new, "id", "at").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_tiers_at_their_thresholds(spark):
    cases = [(65, 15, 6, "ANCHOR"), (64.9, 15, 6, "CLUSTERING"), (65, 14.9, 6, "CLUSTERING"), (65, 15, 5.9, "CLUSTERING"), (50, 10, 0, "CLUSTERING"), (50, 9.9, 9, "DISPLAY_ONLY"), (35, 0, 0, "DISPLAY_ONLY"), (34.9, 20, 9, "REJECTED")]
    df = spark.createDataFrame([(float(a), float(b), float(c), d) for a, b, c, d in cases], "a double, b double, c double, want string")
    assert df.filter(scoring.quality_tier("a", "b", "c") != F.col("want")).count() == 0


def test_photos_with_all(spark):
    faces = spark.createDataFrame([(1, 10, False), (1, 11, False), (2, 10, False), (2, 11, True)], "photo_id long, cluster_id long, deleted boolean")
    clusters = spark.createDataFrame([(10, 1, False), (11, 2, False)], "cluster_id long, person_id long, deleted boolean")
    assert [r.photo_id for r in people.photos_with_all(faces, clusters, [1, 2, 2]).collect()] == [1]
    assert people.photos_with_all(faces, clusters, []).count() == 0


def test_birthdays_wrap_the_year_end(spark):
    df = spark.createDataFrame([(1, "12-31"), (2, "01-02"), (3, "02-29"), (4, None)], "person_id long, birthday string")
    assert sorted(r.person_id for r in people.birthdays(df, "2023-12-30", 5).collect()) == [1, 2]
    assert [r.person_id for r in people.birthdays(df, "2024-02-28", 2).collect()] == [3]


def test_vectors_of_unequal_size(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def faces_of(spark, n=60, groups=5):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(groups, 16))
    v = middle[np.arange(n) % groups] + 0.5 * rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pdf = pd.DataFrame({"face_id": range(n), "photo_id": np.arange(n) // 2, "quality_score": (np.arange(n) * 7) % 66, "v": list(v)})
    rows = [(int(a), int(b), int(c), d.tolist()) for a, b, c, d in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "face_id long, photo_id long, quality_score long, v array<double>")


def test_representatives_are_maintained(spark):
    rng = np.random.default_rng(11)
    poses, held, new = ["FRONTAL", "SLIGHT_LEFT", "PROFILE_LEFT", "SLIGHT_RIGHT"], [], []
    for c in range(40):
        for r in range(7 if c % 8 else 6):
            held.append((c, 100 * c + r, rng.normal(size=4).tolist(), float(rng.integers(40, 100)), poses[int(rng.integers(0, 3 if c % 2 else 4))], r))
        new.append((c, 100 * c + 50, rng.normal(size=4).tolist(), float(rng.integers(40, 120)), poses[int(rng.integers(0, 4))]))
    columns = "cluster_id long, face_id long, v array<double>, quality_score double, pose string"
    got = {r.cluster_id: (r.action, r.replaced) for r in matching.maintain_representatives(spark.createDataFrame(new, columns), spark.createDataFrame(held, columns + ", rank int")).collect()}
    for c, _, v, q, pose in new:
        reps = [h for h in held if h[0] == c]
        count = {}
        for h in reps:
            count[h[4]] = count.get(h[4], 0) + 1
        double = next((h[4] for h in reps if count[h[4]] > 1), None)
        same = [h for h in reps if h[4] == pose]
        worst = min(reps, key=lambda h: (h[3], h[5]))
        cos = min(np.dot(v, h[2]) / np.linalg.norm(v) / np.linalg.norm(h[2]) for h in reps)
        if len(reps) < 7:
            want = ("ADD", None)
        elif not same and double:
            want = ("REPLACE", min((h for h in reps if h[4] == double), key=lambda h: (h[3], h[5]))[1])
        elif same and q > same[0][3] * 1.2:
            want = ("REPLACE", same[0][1])
        elif cos < 0.8 and q > worst[3] * 1.1:
            want = ("REPLACE", worst[1])
        else:
            want = ("NONE", None)
        assert got[c] == want
    assert {x for x, _ in got.values()} == {"ADD", "REPLACE", "NONE"}


def test_splits_by_variance_range_and_parts(spark):
    one, other = np.eye(8)[0], np.eye(8)[1]
    rng = np.random.default_rng(2)
    rows = [(1, i, (one if i % 2 else other) + 0.05 * rng.normal(size=8)) for i in range(8)] + [(2, 100 + i, one + 0.05 * rng.normal(size=8)) for i in range(8)] + [(3, 200 + i, (one if i % 2 else other)) for i in range(4)]
    rows = [(c, i, i, (v / np.linalg.norm(v)).tolist()) for c, i, v in rows]
    faces = spark.createDataFrame(rows, "cluster_id long, face_id long, confidence long, v array<double>")
    got = matching.split_candidates(faces, matching.subgroups(faces)).collect()
    v = np.array([r[3] for r in rows if r[0] == 1])
    middle = v.mean(axis=0)
    sims = v @ (middle / np.linalg.norm(middle))
    variance, spread = ((1 - sims) ** 2).mean(), sims.max() - sims.min()
    sure = min(max(variance - 0.05, 0), 0.15) / 0.15 * 0.4 + min(max(spread - 0.25, 0), 0.35) / 0.35 * 0.3 + 0.7 * 0.3
    assert [(r.cluster_id, r.faces, r.parts, r.auto) for r in got] == [(1, 8, 2, sure >= 0.7)] and abs(got[0].variance - variance) < 1e-6 and abs(got[0].confidence - sure) < 1e-5


def test_hash_descriptor_is_the_plain_loop():
    from kithgraph.operators import imaging

    pixels = np.random.default_rng(1).integers(0, 1 << 24, 40 * 48)
    small = [[int(pixels[(y * 48 // 32) * 40 + x * 40 // 32]) for x in range(32)] for y in range(32)]
    want = []
    for gy in range(4):
        for gx in range(4):
            cell = [small[y][x] for y in range(gy * 8, gy * 8 + 8) for x in range(gx * 8, gx * 8 + 8)]
            want += [sum(p >> k & 255 for p in cell) / 64 / 255 for k in (16, 8, 0)]
    want += [((small[y][x] & 255) - (small[y + 1][x + 1] & 255)) / 255 for y in range(31) for x in range(31)]
    want = np.array(want[:512])
    assert np.allclose(imaging.hash_descriptor(pixels, 40, 48), want / np.linalg.norm(want), atol=1e-6)


def test_a_scan_goes_on_and_a_batch_may_run_again(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for n in (3, 5):
        spark.range(n).select(F.col("id").alias("key")).coalesce(1).write.mode("append").parquet(path)
        assert sorted(r.key for r in jobs.run_scan(spark, path, "key", state=state, max_files=1).collect()) == list(range(n))
    import shutil

    shutil.rmtree(f"{state}/stream/commits")
    assert sorted(r.key for r in jobs.run_scan(spark, path, "key", state=state, max_files=1).collect()) == list(range(5))


def test_ann_finds_most_pairs(spark):
    _, df = faces_of(spark, 120)
    side = df.select(F.col("face_id").alias("id"), F.col("v").alias("vector"))
    exact = {(r.id_a, r.id_b) for r in simjoin.similarity_join(side, side, 0.7).filter("id_a < id_b").collect()}
    near = {(r.id_a, r.id_b) for r in simjoin.ann_join(side, None, 0.7)[0].collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact)


def test_beats_keep_their_gap(spark):
    energy = spark.createDataFrame([(1, t, 10.0 if t in (0, 300, 301, 900) else 0.1) for t in (0, 300, 301, 600, 900, 1200, 1500, 1800)], "track_id long, t_ms long, energy double")
    assert sorted(r.t_ms for r in sequence.detect_beats(energy).collect()) == [0, 301, 900]
    assert sequence.detect_beats(energy.filter("energy < 1")).count() == 0


def test_snapshots_read_back(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "face_id")
    tables.write_snapshot({"faces": df}, str(tmp_path), 1, {"faces": "face_id"})
    tables.write_snapshot({"faces": df.filter("face_id < 5")}, str(tmp_path), 2, {"faces": "face_id"})
    assert tables.read_snapshot(spark, str(tmp_path))["faces"].count() == 5


def test_representatives_are_found_behind_many_near_copies(spark):
    rng = np.random.default_rng(8)
    near = np.eye(16)[0] + 0.01 * rng.normal(size=(70, 16))
    v = np.concatenate([near, np.eye(16)[1:10] + 0.05 * rng.normal(size=(9, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    quality = [100 - i // 10 for i in range(70)] + [50 - i for i in range(9)]
    rows = [(1, i, q, x.tolist()) for i, (q, x) in enumerate(zip(quality, v, strict=True))] + [(2, 100, 50, v[0].tolist())]
    faces = spark.createDataFrame(rows, "cluster_id long, face_id long, quality_score long, v array<double>")
    middle = v.mean(axis=0)
    score = np.round(np.array(quality) / 100 * 0.6 + v @ (middle / np.linalg.norm(middle)) * 0.4, 9)
    kept = []
    for i in np.lexsort((np.arange(len(v)), -score)):
        if len(kept) < 7 and all(v[i] @ v[j] <= 0.85 for j in kept):
            kept.append(int(i))
    assert len(kept) == 7
    got = {(r.cluster_id, r["rank"]): r.face_id for r in clustering.select_representatives(faces).collect()}
    assert got == {(1, n): i for n, i in enumerate(kept)} | {(2, 0): 100}


def test_duplicates_go_over_several_batches_in_any_order_of_time(spark, tmp_path):
    path = str(tmp_path / "events")
    for hour in (5, 1, 9, 0, 3):
        own = spark.createDataFrame([(10 * hour + i, f"2024-01-01 0{hour}:{10 * i}:00") for i in range(5)] + [(90, f"2024-01-01 0{hour}:59:00"), (None, None)], "event_id long, ts string")
        own.coalesce(1).write.mode("append").parquet(path)
    events = jobs.source(spark, path, 1).select("event_id")
    got = [r.event_id for r in jobs.dedup_stream(spark, events, "event_id").collect()]
    assert sorted(got, key=str) == sorted({10 * h + i for h in (5, 1, 9, 0, 3) for i in range(5)} | {None}, key=str)


def test_a_buffer_empties_by_size_and_by_time_whatever_the_batches(spark, tmp_path):
    moments = [0, 1, 1, 2, 3, 4, 5, 9, 10, 23, 24, 31]
    rows = [(i, i % 2, f"2024-01-01 00:00:{second:02d}") for i, second in enumerate(moments)]
    want, seen = {}, {}
    for i, user, _ in rows:
        end = moments[i] // 5 * 5 + 5
        seen[user, end] = seen.get((user, end), 0) + 1
        want[i] = (end, (seen[user, end] + 1) // 2)
    for name, size in (("one", 12), ("many", 1), ("pairs", 2)):
        path = str(tmp_path / name)
        for first in range(0, 12, size):
            own = spark.createDataFrame(rows[first : first + size], "id long, user long, at string")
            own.withColumn("at", F.to_timestamp_ntz("at")).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.source(spark, path, 1)
        got = jobs.stage_and_flush(stream, "user", "at", "id", 2, 5, 60)
        zero = 1_704_067_200
        assert {r.id: (r.flush_second - zero, r.flush) for r in got.collect()} == want


def test_late_rows_and_rows_without_a_time_are_flushed(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(1, "2024-01-01 00:00:01"), (2, None)], [(3, "2024-01-01 00:01:00")], [(4, "2024-01-01 00:00:02")]):
        own = spark.createDataFrame(rows, "id long, at string").withColumn("at", F.to_timestamp_ntz("at"))
        own.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.source(spark, path, 1).withColumn("user", F.lit("u"))
    got = {r.id: (r.flush_second and r.flush_second % 1000, r.flush) for r in jobs.stage_and_flush(stream, "user", "at", "id", 9, 5, 10).collect()}
    assert got == {1: (205, 1), 2: (None, 1), 3: (265, 1), 4: (205, 1)}
    empty = jobs.stage_and_flush(jobs.source(spark, path).filter("id > 9").withColumn("user", F.lit("u")), "user", "at", "id")
    assert empty.count() == 0


def test_throttle_keeps_what_a_plain_pass_keeps(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k == 3 else int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.choice(4, 600, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 4000, 600), strict=True))]
    want = []
    for key in {r[0] for r in rows}:
        last = None
        for _, i, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is None or t - last >= 25:
                want.append(i)
                last = t
    events = spark.createDataFrame(rows, "album_id long, image_id long, t_ms long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [r.image_id for r in sequence.throttle(events, 25).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(got) == sorted(want)
    assert sequence.throttle(events.filter("image_id < 0"), 25).count() == 0


def test_pixel_levels_are_cut_in_float_arithmetic(spark):
    from kithgraph.operators import imaging

    values = np.float32([-0.094488226, 0.0, 1.0])
    df = spark.createDataFrame([(values.tolist(),)], "e array<float>")
    # In double arithmetic the first is 114.9999953, in float 115.
    assert df.select(imaging.levels("e")).first()[0] == [115, 127, 254] == ((values + np.float32(1)) * np.float32(127)).astype(int).tolist()
