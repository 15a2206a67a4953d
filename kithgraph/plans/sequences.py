"""Slideshow and session queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.operators import sequence as q
from kithgraph.plans.catalog import query

M1 = "SELECT album_id, n, days, places, CASE WHEN days <= 1 AND n >= 5 THEN 'CELEBRATION' WHEN days > 2 AND places >= 2 THEN 'TRAVEL' WHEN days > 30 THEN 'MEMORIES' WHEN n <= 5 THEN 'SOCIAL' ELSE 'MEMORIES' END AS story FROM (SELECT album_id, count(*) AS n, date_diff('day', min(date_taken)::date, max(date_taken)::date) AS days, count(DISTINCT place_name) AS places FROM v_images GROUP BY 1)"


@query("m1_story_profile", M1)
def profile(v):
    return q.story_profile(v.images)


M3 = "SELECT image_id, CASE WHEN b IS NULL OR date_taken::date <> b THEN concat_ws(' • ', place_name, strftime(date_taken, '%B %-d, %Y')) ELSE coalesce(place_name, '') END AS caption FROM (SELECT *, lag(date_taken::date) OVER (PARTITION BY album_id ORDER BY date_taken, image_id) AS b FROM v_images)"


@query("m3_smart_captions", M3)
def captions(v):
    return q.smart_captions(v.images)


M4 = "SELECT image_id, place_name FROM (SELECT image_id, place_name, lag(place_name) OVER (PARTITION BY album_id ORDER BY date_taken, image_id) AS b FROM v_images WHERE place_name IS NOT NULL) WHERE b IS NULL OR b <> place_name"


@query("m4_place_changes", M4)
def places(v):
    return q.place_changes(v.images)


SAMPLES = ", s AS (SELECT album_id AS track_id, (row_number() OVER (PARTITION BY album_id ORDER BY date_taken, image_id) - 1) * 20 AS t_ms, coalesce(duration_s, 1) AS x FROM v_images)"


def samples(v):
    place = F.row_number().over(W.partitionBy("album_id").orderBy("date_taken", "image_id")) - 1
    return v.images.select(F.col("album_id").alias("track_id"), (place * 20).cast("long").alias("t_ms"), F.coalesce("duration_s", F.lit(1.0)).alias("x"))


@query("m5_rms_energy", SAMPLES + "SELECT track_id, t_ms // 50 * 50 AS t_ms, round(sqrt(avg(x * x)), 6) AS energy FROM s GROUP BY 1, 2")
def energy(v):
    return q.rms_energy(samples(v)).withColumn("energy", F.round("energy", 6))


def beats(v):
    return q.detect_beats(samples(v).select("track_id", (F.col("t_ms") * 5).alias("t_ms"), F.col("x").alias("energy")))


PEAKS = """s AS (SELECT user_id AS track_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 100 AS t_ms, CASE WHEN event_id % 6 = 0 THEN 1 ELSE value END AS x FROM events),
p AS (SELECT track_id, t_ms FROM (SELECT *, avg(x) OVER (PARTITION BY track_id) AS mean FROM s) WHERE x > mean * 1.5),
k AS (SELECT track_id, t_ms, row_number() OVER w AS n, 1 + count(*) OVER (PARTITION BY track_id ORDER BY t_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 300 FOLLOWING) AS after FROM p WINDOW w AS (PARTITION BY track_id ORDER BY t_ms)),
b AS (SELECT * FROM k WHERE n = 1 UNION ALL SELECT k.* FROM b JOIN k ON k.track_id = b.track_id AND k.n = b.after)
"""


@query("m6_detect_beats", "WITH RECURSIVE " + PEAKS + "SELECT track_id, t_ms FROM b", raw=True)
def detect(v):
    return beats(v)


@query("m6_tempo", "WITH RECURSIVE " + PEAKS + "SELECT track_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round(60000 / ((max(t_ms) - min(t_ms)) / (count(*) - 1)), 6) ELSE 120 END::double AS bpm FROM b GROUP BY 1", raw=True)
def tempo(v):
    return q.tempo(beats(v)).withColumn("bpm", F.round("bpm", 6))


@query("m7_even_beats", "SELECT person_id AS track_id, unnest(range(0, 10000 + person_id * 100, (60000 // (60 + person_id % 90))::bigint)) AS t_ms FROM v_persons")
def even(v):
    tracks = v.persons.select(F.col("person_id").alias("track_id"), (60 + F.col("person_id") % 90).alias("bpm"), (10000 + F.col("person_id") * 100).alias("duration_ms"))
    return q.even_beats(tracks)


M8 = """
, img AS (SELECT album_id, image_id, row_number() OVER (PARTITION BY album_id ORDER BY date_taken, image_id) - 1 AS pos, count(*) OVER (PARTITION BY album_id) AS images FROM v_images),
b AS (SELECT album_id, i, i * 700 AS t_ms, 3 + album_id % 40 AS beats FROM (SELECT DISTINCT album_id FROM v_images WHERE album_id % 7 <> 0) JOIN (SELECT unnest(range(0, 43)) AS i) ON i < 3 + album_id % 40),
x AS (SELECT img.*, n.beats, least(floor(pos * greatest(n.beats / images, 1)), n.beats - 1) AS f, least(floor((pos + 1) * greatest(n.beats / images, 1)), n.beats - 1) AS l FROM img LEFT JOIN (SELECT DISTINCT album_id, beats FROM b) n USING (album_id))
SELECT album_id, image_id, CASE WHEN beats IS NULL THEN 2.0 ELSE greatest(0.5, least(5.0, (CASE WHEN l < beats - 1 THEN l * 700 ELSE 40000 END - f * 700) / 1000)) END::double AS seconds FROM x
"""


@query("m8_beat_durations", M8)
def beat_durations(v):
    place = F.row_number().over(W.partitionBy("album_id").orderBy("date_taken", "image_id")) - 1
    images = v.images.select("album_id", "image_id", place.alias("pos"))
    albums = v.images.filter("album_id % 7 <> 0").select(F.col("album_id").alias("track_id")).distinct()
    marks = albums.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), 2 + F.col("track_id") % 40)).alias("i")).select("track_id", (F.col("i") * 700).alias("t_ms"))
    return q.beat_durations(images, marks, albums.select("track_id", F.lit(40000).alias("end_ms")))


M9 = "SELECT album_id, image_id, round(coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_s, round(sum(d) OVER w, 4) AS end_s FROM (SELECT *, coalesce(duration_s, 2.0) AS d FROM v_images) WINDOW w AS (PARTITION BY album_id ORDER BY date_taken, image_id)"


@query("m9_timeline", M9)
def timeline(v):
    return q.timeline(v.images)


M10 = ", x AS (SELECT image_id, floor(2.0 * (1 + image_id % 3) * 5)::bigint AS n FROM v_images), y AS (SELECT image_id, n, n - floor(n * 0.2)::bigint AS c, unnest(range(0, n)) AS frame FROM x) SELECT image_id, frame, round(CASE WHEN frame >= c THEN (frame - c) / (n - c) ELSE 0 END, 6)::double AS progress, (frame * 1000000 // 5) AS at_us FROM y"


@query("m10_frame_plan", M10)
def frames(v):
    return q.frame_plan(v.images.select("image_id", (2.0 * (1 + F.col("image_id") % 3)).alias("seconds")), 5)


T2 = "SELECT album_id, image_id, sum(fresh) OVER (PARTITION BY album_id ORDER BY date_taken, image_id)::bigint AS session FROM (SELECT *, CASE WHEN lag(date_taken) OVER (PARTITION BY album_id ORDER BY date_taken, image_id) >= date_taken - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM v_images)"


@query("t2_sessions", T2)
def sessions(v):
    return q.sessions(v.images).select("album_id", "image_id", "session")


J9 = "SELECT p.image_id, s.image_id AS other FROM v_images p JOIN v_images s ON p.album_id = s.album_id AND p.image_id <> s.image_id AND p.date_taken BETWEEN s.date_taken - INTERVAL 1 HOUR AND s.date_taken + INTERVAL 1 HOUR"


@query("j9_session_candidates", J9)
def candidates(v):
    """Range join: each time meets the three hour buckets around it."""
    hour = F.floor(F.unix_timestamp(F.col("date_taken").cast("timestamp")) / 3600)
    a = v.images.select("album_id", F.col("image_id"), F.col("date_taken").alias("t"), F.explode(F.array(hour - 1, hour, hour + 1)).alias("hour"))
    b = v.images.select("album_id", F.col("image_id").alias("other"), F.col("date_taken").alias("u"), hour.alias("hour"))
    near = (F.col("t") >= F.col("u") - F.expr("INTERVAL 1 HOUR")) & (F.col("t") <= F.col("u") + F.expr("INTERVAL 1 HOUR"))
    return a.join(b, ["album_id", "hour"]).filter(near & (F.col("image_id") != F.col("other"))).select("image_id", "other")


T8 = "SELECT image_id FROM (SELECT *, lead(t_ms) OVER (PARTITION BY album_id ORDER BY t_ms, image_id) AS a FROM (SELECT album_id, image_id, epoch_ms(date_taken) AS t_ms FROM v_images)) WHERE a IS NULL OR a - t_ms > 600000"


def in_ms(v):
    return v.images.select("album_id", "image_id", F.unix_millis(F.col("date_taken").cast("timestamp")).alias("t_ms"), "date_taken", "place_name")


@query("t8_debounce", T8)
def debounce(v):
    return q.debounce(in_ms(v), 600000).select("image_id")


THROTTLE = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t_ms FROM events),
k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS n, 1 + count(*) OVER (PARTITION BY user_id ORDER BY t_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 599999 FOLLOWING) AS after FROM e),
b AS (SELECT * FROM k WHERE n = 1 UNION ALL SELECT k.* FROM b JOIN k ON k.user_id = b.user_id AND k.n = b.after)
SELECT event_id AS image_id FROM b"""


@query("t8_throttle", THROTTLE, raw=True)
def throttle(v):
    return q.throttle(in_ms(v).select("album_id", "image_id", "t_ms"), 600000)


@query("t8_distinct_until_changed", "SELECT image_id, place_name FROM (SELECT *, row_number() OVER w AS n, lag(place_name) OVER w AS b FROM v_images WINDOW w AS (PARTITION BY album_id ORDER BY date_taken, image_id)) WHERE n = 1 OR place_name IS DISTINCT FROM b")
def unchanged(v):
    return q.distinct_until_changed(v.images, "place_name").select("image_id", "place_name")
