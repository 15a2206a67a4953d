"""Streams with keyed state: any cut into batches and restarts give what one pass gives."""

import shutil

import numpy as np
from pyspark.sql import functions as F

from kithgraph.streaming import buffers, jobs, views


def rows_of(n=60, seed=3):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 90_000, n) * (1 + rng.integers(0, 2, n)))
    return [(f"k{i % 3}", i, int(t)) for i, t in enumerate(at)]


def one_pass(rows, most, wait):
    out, held, flushes = {}, {}, {}

    def flush(key, at, reason):
        flushes[key] = flushes.get(key, 0) + 1
        out.update({i: (key, flushes[key], at, reason) for i, _ in held.pop(key)})

    for key, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if key in held and t > held[key][0][1] + wait:
            flush(key, held[key][0][1] + wait, "TIME")
        held.setdefault(key, []).append((i, t))
        if len(held[key]) >= most:
            flush(key, t, "SIZE")
    for key in list(held):
        flush(key, held[key][0][1] + wait, "TIME")
    return out


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "key string, row_id long, t long").select("key", "row_id", F.timestamp_millis("t").alias("at"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_a_buffer_empties_by_size_and_timer_whatever_the_batches(spark, tmp_path):
    rows, path = rows_of(), str(tmp_path / "in")
    for first in range(0, len(rows), 25):
        write(spark, rows[first : first + 25], path)
    got = buffers.drain_staged(spark, jobs.source(spark, path, 1), most=5, wait_ms=20_000).collect()
    assert {r.row_id: (r.key, r.flush, r.at_ms, r.reason) for r in got} == one_pass(rows, 5, 20_000) and len(got) == len(rows)
    assert {r.reason for r in got} == {"SIZE", "TIME"}


class Held:
    """One key's state in memory; counts calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getListState", "getValueState"):
                own = Held()
                self.__dict__.setdefault("states", []).append(own)
                return own
            if name == "get":
                return self.value
            if name in ("put", "update"):
                self.value = args[0]
            if name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.remove)(args[0])
            return None

        return call

    def total(self):
        return self.calls + sum(x.calls for x in self.states)


def test_a_key_costs_few_frames_and_few_calls_to_its_state():
    import pandas as pd

    rows = pd.DataFrame({"row_id": range(4000), "at_ms": [i * 100 for i in range(4000)]})
    handle, buffer = Held(), buffers.StagingBuffer(7, 20_000)
    buffer.init(handle)
    out = list(buffer.handleInputRows(("k",), iter([rows]), None))
    assert len(out) == 1 and len(out[0]) == 3997 and handle.total() <= 8


def test_open_sessions_of_a_key_share_a_timer():
    import pandas as pd

    handle, sessions = Held(), buffers.Sessions(50)
    sessions.init(handle)
    handle.states[0].value = []
    rows = pd.DataFrame({"row_id": range(500), "at_ms": [i * 100 for i in range(500)]})
    list(sessions.handleInputRows(("k",), iter([rows]), None))
    assert len(handle.states[0].value) == 500 and handle.timers == {50}

    class At:
        def getExpiryTimeInMs(self):  # noqa: N802
            return 50

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10_000

    closed = list(sessions.handleExpiredTimer(("k",), At(), At()))
    assert [len(x) for x in closed] == [100] and len(handle.states[0].value) == 400 and 10_050 in handle.timers


def test_a_buffer_goes_on_after_a_restart(spark, tmp_path):
    rows, path, folder = rows_of(40, 8), str(tmp_path / "in"), str(tmp_path / "buffer")
    for part in (rows[:15], rows[15:31], rows[31:]):
        write(spark, part, path)
        got = buffers.drain_staged(spark, jobs.source(spark, path, 1), folder, most=4, wait_ms=20_000).collect()
    assert {r.row_id: (r.key, r.flush, r.at_ms, r.reason) for r in got} == one_pass(rows, 4, 20_000) and len(got) == len(rows)


def test_keys_of_all_batches_are_known_after_a_restart(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for low, high in ((0, 5), (3, 9), (0, 12)):
        spark.range(low, high).select(F.col("id").alias("key")).coalesce(1).write.mode("append").parquet(path)
        got = [r.key for r in jobs.dedup_stream(spark, jobs.source(spark, path, 1), "key", state).collect()]
        assert sorted(got) == list(range(high))
        size = spark.read.parquet(f"{state}/rows").count()
        assert size == high
    shutil.rmtree(f"{state}/stream/commits")
    assert sorted(r.key for r in jobs.dedup_stream(spark, jobs.source(spark, path, 1), "key", state).collect()) == list(range(12))


def test_sessions_merge_rows_in_any_order_and_go_on_after_a_restart(spark, tmp_path):
    rows, path, folder = rows_of(60, 5), str(tmp_path / "in"), str(tmp_path / "sessions")
    want = set()
    for key in {r[0] for r in rows}:
        own = sorted(t for k, _, t in rows if k == key)
        cuts = [0, *(i for i in range(1, len(own)) if own[i] - own[i - 1] > 6_000), len(own)]
        want |= {(key, own[a], own[b - 1], b - a) for a, b in zip(cuts, cuts[1:], strict=False)}
    mixed = [rows[i] for i in np.random.default_rng(2).permutation(60)]
    for part in (mixed[:25], mixed[25:40], mixed[40:]):
        write(spark, part, path)
        got = buffers.drain_sessions(spark, jobs.source(spark, path, 1), 6_000, folder, delay_ms=10_000_000).collect()
    assert {(r.key, r.first_ms, r.last_ms, r.rows) for r in got} == want and all(r.open for r in got)
    write(spark, [("k0", 999, 50_000_000)], path)
    last = buffers.drain_sessions(spark, jobs.source(spark, path, 1), 6_000, folder, delay_ms=10_000_000).collect()
    assert {(r.key, r.first_ms, r.last_ms, r.rows) for r in last if not r.open} == want


def test_throttle_and_debounce_whatever_the_batches(spark, tmp_path):
    rows, path = rows_of(60, 9), str(tmp_path / "in")
    for first in range(0, 60, 20):
        write(spark, rows[first : first + 20], path)
    passed, quiet = set(), set()
    for key in {r[0] for r in rows}:
        own, last = sorted((t, i) for k, i, t in rows if k == key), None
        for n, (t, i) in enumerate(own):
            if last is None or t - last >= 4_000:
                passed.add(i)
                last = t
            if n + 1 == len(own) or own[n + 1][0] - t > 4_000:
                quiet.add(i)
    assert {r.row_id for r in buffers.drain_quiet(spark, jobs.source(spark, path, 1), 4_000).collect()} == passed
    assert {r.row_id for r in buffers.drain_quiet(spark, jobs.source(spark, path, 1), 4_000, debounce=True).collect()} == quiet


def test_a_view_equals_its_batch_form_after_every_batch_and_reads_what_changed(spark, tmp_path):
    rng, rows, path = np.random.default_rng(4), {}, str(tmp_path / "in")
    seen, read = [], []
    for batch in range(4):
        size = 400 if batch == 0 else 3
        for i in rng.integers(0, 400, size):
            rows[int(i)] = (int(i) % 50, int(i), bool(rng.integers(0, 2)), batch, bool(rng.integers(0, 9) == 0))
        log = [r for r in rows.values() if r[3] == batch]
        spark.createDataFrame(log, "cluster_id long, anchor_id long, is_active boolean, at long, gone boolean").coalesce(1).write.mode("append").parquet(path)
        want = {}
        for cluster, _, active, _, gone in rows.values():
            if not gone:
                want[cluster] = want.get(cluster, 0) + active
        seen.append(want)

    def check(number, view, rows_read):
        assert {r.cluster_id: r.n for r in view.collect()} == seen[number]
        read.append(rows_read)

    counts = lambda df: df.groupBy("cluster_id").agg(F.count_if("is_active").alias("n"))
    got = views.grouped_view(spark, jobs.source(spark, path, 1), "cluster_id", "anchor_id", "cluster_id long, anchor_id long, is_active boolean", counts, str(tmp_path / "view"), check)
    assert {r.cluster_id: r.n for r in got.collect()} == seen[-1]
    assert len(read) == 4 and read[0] == 0 and max(read[1:]) < 0.3 * len(rows)


def test_a_batch_finds_what_it_touched_without_dealing_rows_again(spark, tmp_path):
    kept = views.Kept(spark, str(tmp_path / "kept"), "key", "item", "key long, item long, value long")
    found = []
    for number, log in enumerate(([(i % 7, i, 1) for i in range(50)], [(3, 3, 2), (60, 60, 2), (5, 5, 2)])):
        rows = [(*r, number, r[1] == 5 and number == 1) for r in log]
        before, now = kept.apply(spark.createDataFrame(rows, "key long, item long, value long, at long, gone boolean"), number)
        plan = now._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        found.append([sorted(tuple(r)[:3] for r in x.collect()) for x in (before, now)])
    assert found[0] == [[], sorted((i % 7, i, 1) for i in range(50))]
    assert found[1] == [[(3, 3, 1), (5, 5, 1)], [(3, 3, 2), (60, 60, 2)]]
    assert kept.rows(1).columns == ["key", "item", "value", "at", "gone"] and kept.rows(1).count() == 51


def test_persons_with_face_follow_moves_deletions_and_new_owners(spark, tmp_path):
    rng = np.random.default_rng(8)
    kept = views.PersonsWithFace(spark, str(tmp_path / "persons"))
    faces, clusters, persons = {}, {}, {}
    for number in range(3):
        for c in range(12) if number == 0 else rng.integers(0, 14, 2).tolist():
            clusters[c] = (None if c % 5 == 4 else int(rng.integers(0, 6)), bool(rng.integers(0, 6) == 0), number)
        for p in range(6) if number == 0 else [int(rng.integers(0, 7))]:
            persons[p] = (f"name {p}", p * 3, bool(rng.integers(0, 4) == 0), bool(rng.integers(0, 8) == 0), number)
        for f in range(40) if number == 0 else rng.integers(0, 44, 6).tolist():
            faces[f] = (None if rng.integers(0, 9) == 0 else int(rng.integers(0, 12)), ("ANCHOR", "CLUSTERING", "DISPLAY_ONLY")[int(rng.integers(0, 3))], float(rng.integers(40, 60)), float(rng.integers(0, 3)), bool(rng.integers(0, 7) == 0), number)
        face_log = [(str(i), c, t, q, m, 1.0, number, g) for i, (c, t, q, m, g, n) in faces.items() if n == number]
        cluster_log = [(c, p, g) for c, (p, g, n) in clusters.items() if n == number]
        person_log = [(p, name, count, hidden, g) for p, (name, count, hidden, g, n) in persons.items() if n == number]
        kept.apply(
            spark.createDataFrame(face_log, views.FACE + ", at long, gone boolean"), spark.createDataFrame(cluster_log, "cluster_id long, person_id long, gone boolean"),
            spark.createDataFrame(person_log, "person_id long, name string, photo_count long, hidden boolean, gone boolean"), number,
        )
        want = {}
        for p, (name, count, hidden, gone, _) in persons.items():
            own = [(-q, -m, str(i)) for i, (c, t, q, m, g, _) in faces.items() if not g and c in clusters and clusters[c][0] == p and not clusters[c][1] and t != "DISPLAY_ONLY"]
            if own and not hidden and not gone:
                want[p] = (name, count, min(own)[2])
        assert {r.person_id: (r.name, r.photo_count, r.face_id) for r in kept.view(number).collect()} == want
        again = kept.faces.read_rows
        assert number == 0 or again < 40


def test_sessions_are_windows_of_the_engine_and_end_a_gap_after_the_last_row(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "sessions")
    batches = [[("a", 0, 0), ("a", 1, 1000), ("b", 2, 0), ("b", 3, 1001), ("c", 4, 5000), ("e", 5, 0)], [("a", 6, 2000), ("b", 7, 2002), ("c", 8, 4000), ("c", 9, 6001), ("e", 10, 2000)], [("e", 11, 1000)]]
    for rows in batches:
        write(spark, rows, path)
    got = buffers.drain_sessions(spark, jobs.source(spark, path, 1), 1000, folder, delay_ms=10_000_000).collect()
    want = {("a", 0, 2000, 3), ("b", 0, 0, 1), ("b", 1001, 1001, 1), ("b", 2002, 2002, 1), ("c", 4000, 5000, 2), ("c", 6001, 6001, 1), ("e", 0, 2000, 3)}
    assert {(r.key, r.first_ms, r.last_ms, r.rows) for r in got} == want and len(got) == len(want)
    assert [r.operatorName for r in spark.read.format("state-metadata").load(f"{folder}/state").select("operatorName").distinct().collect()] == ["sessionWindowStateStoreSaveExec"]
