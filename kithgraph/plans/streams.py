"""Streaming jobs over the tables, drained to their end."""

from pyspark.sql import functions as F

from kithgraph.operators import matching
from kithgraph.plans.catalog import query
from kithgraph.plans.matching import WEIGHTED, decided
from kithgraph.plans.people import W1
from kithgraph.plans.vectors import planted
from kithgraph.sources.fixtures import VIEWS
from kithgraph.streaming import buffers, jobs, views


@query("t1_run_scan", "SELECT DISTINCT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'NO_FACES' ELSE 'SCANNED' END AS scan_status FROM orders", raw=True)
def run_scan(v):
    status = F.when(F.col("o_orderstatus") == "O", "NO_FACES").otherwise("SCANNED")
    return jobs.run_scan(v.spark, f"{v.sf_dir}/orders.parquet", "o_orderkey", status)


T5 = """SELECT user_id, rows, failed, most, floor(done * 100 / rows)::bigint AS percent, 'row ' || wrong AS message,
 CASE WHEN done = rows THEN 'COMPLETE' WHEN newest = 'signup' THEN 'PAUSED' WHEN wrong IS NOT NULL THEN 'ERROR' ELSE 'SCANNING' END AS state
FROM (SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'view') AS done, max(value) AS most,
 last(event_type ORDER BY ts, event_id) AS newest, last(event_id ORDER BY ts, event_id) FILTER (event_type = 'error') AS wrong FROM events GROUP BY 1)"""


@query("t5_progress", T5, raw=True)
def progress(v):
    return jobs.complete(v.spark, jobs.progress(jobs.source(v.spark, f"{v.sf_dir}/events.parquet"), "user_id"))


@query("t7_live_view", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1", raw=True)
def live_view(v):
    changes = jobs.source(v.spark, f"{v.sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return jobs.live_view(v.spark, changes, "user_id", "ts").select("user_id", "event_id", "event_type")


@query("t9_dedup_stream", "SELECT DISTINCT event_id FROM events", raw=True)
def dedup(v):
    return jobs.dedup_stream(v.spark, jobs.source(v.spark, f"{v.sf_dir}/events.parquet").select("event_id"), "event_id")


T3 = """SELECT event_id, user_id, flush_second, ((row_number() OVER (PARTITION BY user_id, flush_second ORDER BY ts, event_id) + 7) // 8)::bigint AS flush
FROM (SELECT *, ((epoch_us(ts) // 432000000000 + 1) * 432000)::bigint AS flush_second FROM events)"""


@query("t3_stage_and_flush", T3, raw=True)
def stage_and_flush(v):
    """A user's events are the uncertain rows of one candidate; they are sparse, so a buffer has eight rows or five days."""
    events = jobs.source(v.spark, f"{v.sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return jobs.stage_and_flush(events, "user_id", "ts", "event_id", 8, 432_000).select("event_id", "user_id", "flush_second", "flush")


#: The tables' files come in no order of time: ten years late is not late.
LATE = 10 * 366 * 86_400_000
#: Buffers as a chain: each begins where the one before it ended, has ``most`` rows or those of ``wait`` milliseconds after its first.
CHAIN = """n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, row_id) AS n, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {wait} FOLLOWING) AS upto FROM r),
c AS (SELECT *, least({most}, upto - n + 1) AS take FROM n),
b AS (SELECT key, n, t, take, 1 AS flush FROM c WHERE n = 1 UNION ALL SELECT c.key, c.n, c.t, c.take, b.flush + 1 FROM b JOIN c ON c.key = b.key AND c.n = b.n + b.take),
flushed AS (SELECT c.key, c.row_id, b.flush::BIGINT AS flush, (CASE WHEN b.take = {most} THEN l.t ELSE b.t + {wait} END)::BIGINT AS at_ms, CASE WHEN b.take = {most} THEN 'SIZE' ELSE 'TIME' END AS reason
  FROM b JOIN c ON c.key = b.key AND c.n BETWEEN b.n AND b.n + b.take - 1 JOIN c l ON l.key = b.key AND l.n = b.n + b.take - 1)
"""
T3B = "WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS key, event_id AS row_id, epoch_us(ts) // 1000 AS t FROM events),\n" + CHAIN.format(most=8, wait=432_000_000) + "SELECT key, row_id, flush, at_ms, reason FROM flushed"


@query("t3_staging_buffer", T3B, raw=True)
def staging_buffer(v):
    """The same rows held in keyed state: the eighth row of a user empties the buffer at once, a timer five days after the first."""
    events = jobs.source(v.spark, f"{v.sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("at"))
    return buffers.drain_staged(v.spark, rows, most=8, wait_ms=432_000_000, delay_ms=LATE)


#: Bursts of a hundred faces, one every two seconds; a burst begins 500 seconds after the last, the first after a day.
DEFERRED = "(86400 + vec_id * 2 + vec_id // 100 * 300)"
T4 = WEIGHTED.replace("WITH proto", "WITH RECURSIVE proto") + ", rr AS (SELECT (vec_id % 8)::VARCHAR AS key, vec_id AS row_id, " + DEFERRED + " * 1000 AS t FROM embeddings),\n" + CHAIN.format(most=15, wait=600_000).replace("FROM r)", "FROM rr)").replace("b AS (", "bb AS (").replace(" FROM b ", " FROM bb b ") + """, o AS (SELECT *, zone <> 'UNCERTAIN' OR gap >= 0.10 OR support >= 2 OR sim >= 0.62 AS ok FROM d),
q AS (SELECT face_id, CASE WHEN sim >= 0.55 AND ok THEN cluster_id END AS cluster_id, CASE WHEN sim >= 0.55 AND ok THEN 'ASSIGNED' WHEN sim < 0.55 AND quality_score >= 65 THEN 'NEW' ELSE 'KEPT' END AS outcome FROM o)
SELECT face_id, cluster_id, outcome, reason, at_ms // 1000 + CASE outcome WHEN 'ASSIGNED' THEN 0 ELSE 600 END AS resolved_second FROM q JOIN flushed ON row_id = face_id"""


@query("t4_deferred_pool", T4, raw=True)
def deferred_pool(v):
    """Faces deferred to eight pools; a pool of 15 rows or ten minutes goes to the second pass.

    Who is not assigned there waits in the next pool, where ten minutes have passed for all: a new cluster, or kept for good.
    """
    second = F.expr("86400 + vec_id * 2 + vec_id DIV 100 * 300")
    faces = jobs.source(v.spark, f"{v.sf_dir}/embeddings.parquet").select((F.col("vec_id") % 8).cast("string").alias("key"), F.col("vec_id").alias("row_id"), F.timestamp_seconds(second).alias("at"))
    looks = buffers.drain_staged(v.spark, faces, most=15, wait_ms=600_000, delay_ms=LATE).select(F.col("row_id").alias("face_id"), "at_ms", "reason")
    more = planted(v).select("face_id", F.col("quality_score").alias("quality"), F.expr("(86400 + face_id * 2 + face_id DIV 100 * 300) * 1000").alias("since")).join(looks, "face_id")
    minutes = ((F.col("at_ms") - F.col("since")) / 60_000 + 10).alias("minutes")
    found = matching.second_pass(decided(v).join(more.select("face_id", "quality", minutes), "face_id"))
    resolved = F.expr("at_ms DIV 1000") + F.when(F.col("outcome") == "ASSIGNED", 0).otherwise(600)
    return found.join(looks, "face_id").select("face_id", "cluster_id", "outcome", "reason", resolved.alias("resolved_second"))


def user_events(v):
    events = jobs.source(v.spark, f"{v.sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("at"))


T2 = """SELECT key, min(t) AS first_ms, max(t) AS last_ms, count(*) AS rows FROM (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t, event_id) AS nth FROM
 (SELECT user_id::VARCHAR AS key, event_id, epoch_us(ts) // 1000 AS t, CASE WHEN lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= epoch_us(ts) // 1000 - 3600000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY key, nth"""


@query("t2_session_stream", T2, raw=True)
def session_stream(v):
    """Sessions of an hour as keyed state; open ones count too."""
    return buffers.drain_sessions(v.spark, user_events(v), 3_600_000, delay_ms=LATE).drop("open")


T8 = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, 1 + count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 599999 FOLLOWING) AS after, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM e),
b AS (SELECT * FROM k WHERE n = 1 UNION ALL SELECT k.* FROM b JOIN k ON k.user_id = b.user_id AND k.n = b.after)
"""


@query("t8_throttle_stream", T8 + "SELECT event_id AS row_id FROM b", raw=True)
def throttle_stream(v):
    return buffers.drain_quiet(v.spark, user_events(v), 600_000, delay_ms=LATE)


@query("t8_debounce_stream", T8 + "SELECT event_id AS row_id FROM k WHERE next IS NULL OR next - t > 600000", raw=True)
def debounce_stream(v):
    return buffers.drain_quiet(v.spark, user_events(v), 600_000, debounce=True, delay_ms=LATE)


def changes(v, view, gone="deleted"):
    """A view's rows as a change log."""
    source, columns = VIEWS[view]
    return jobs.source(v.spark, f"{v.sf_dir}/{source}.parquet").selectExpr(*columns).withColumn("at", F.lit(0).cast("long")).withColumn("gone", F.expr(gone))


@query("t7_visible_persons", "SELECT person_id, name, photo_count FROM v_persons WHERE NOT is_hidden AND NOT deleted")
def visible_persons(v):
    log = changes(v, "v_persons")
    shown = lambda rows: rows.filter("NOT is_hidden").select("person_id", "name", "photo_count")
    return views.grouped_view(v.spark, log, "person_id", "person_id", "person_id long, name string, photo_count long, is_hidden boolean", shown)


@query("t7_anchor_counts", "SELECT cluster_id, count(*) FILTER (is_active) AS anchors FROM v_anchors GROUP BY 1")
def anchor_counts(v):
    log = changes(v, "v_anchors", "false")
    counts = lambda rows: rows.groupBy("cluster_id").agg(F.count_if("is_active").alias("anchors"))
    return views.grouped_view(v.spark, log, "cluster_id", "anchor_id", "cluster_id long, anchor_id string, is_active boolean", counts)


@query("t7_pending_counts", "SELECT bucket_name, count(*) FILTER (scan_status = 'PENDING') AS pending FROM v_photos GROUP BY 1")
def pending_counts(v):
    log = changes(v, "v_photos", "false").withColumn("bucket", F.expr("photo_id % 32"))
    # A bucket of photos is a group, so that a folder with many photos is many; the counts of a folder are few rows to add up.
    parts = lambda rows: rows.groupBy("bucket_name").agg(F.count_if(F.col("scan_status") == "PENDING").alias("pending"))
    return views.grouped_view(v.spark, log, "bucket", "photo_id", "bucket long, photo_id long, bucket_name string, scan_status string", parts)


@query("t7_persons_with_face", W1.replace(", f.photo_id", ""))
def persons_with_face(v):
    """Faces come as a stream; the persons and clusters that are there come with its first batch."""
    kept, last = views.PersonsWithFace(v.spark), []

    def step(batch, number):
        clusters = v.clusters.select("cluster_id", "person_id", F.col("deleted").alias("gone"))
        persons = v.persons.select("person_id", "name", "photo_count", F.col("is_hidden").alias("hidden"), F.col("deleted").alias("gone"))
        first = number == 0
        kept.apply(views.faces_as_changes(batch, "0"), clusters if first else clusters.limit(0), persons if first else persons.limit(0), number)
        last[:] = [number]

    jobs.drain(jobs.source(v.spark, f"{v.sf_dir}/lineitem.parquet").selectExpr(*VIEWS["v_faces"][1]), step)
    return kept.view(last[0]).select("person_id", "name", "photo_count", "face_id")
