"""Representatives, promotion, audits, dimension picks and image measurements."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions import scoring as s
from kithgraph.functions import vectors as x
from kithgraph.operators import clustering as k
from kithgraph.operators import imaging, people
from kithgraph.plans import scores
from kithgraph.plans.catalog import query
from kithgraph.sources.storage import saved
from kithgraph.plans.matching import QUARTERS, quarters
from kithgraph.plans.vectors import PLANTED, planted

POSES = QUARTERS + ", a AS (SELECT *, " + s.POSE_SQL.format(yaw="yaw") + " AS pose FROM g WHERE quality_score >= 65)\n"

K10 = POSES + """, p AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, a.face_id AS id_a, b.face_id AS id_b, round(list_dot_product(a.v, b.v), 6) AS sim, a.pose AS pa, b.pose AS pb FROM a JOIN a b ON a.cluster_id < b.cluster_id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.55),
q AS (SELECT *, round(least(1, sim + CASE WHEN pa = pb THEN 0.15 WHEN (pa = 'FRONTAL' AND pb LIKE 'SLIGHT%') OR (pb = 'FRONTAL' AND pa LIKE 'SLIGHT%') THEN 0.12
 WHEN (pa = 'SLIGHT_LEFT' AND pb = 'PROFILE_LEFT') OR (pa = 'PROFILE_LEFT' AND pb = 'SLIGHT_LEFT') OR (pa = 'SLIGHT_RIGHT' AND pb = 'PROFILE_RIGHT') OR (pa = 'PROFILE_RIGHT' AND pb = 'SLIGHT_RIGHT') THEN 0.08 ELSE 0.03 END), 6) AS confidence FROM p)
SELECT cluster_a, cluster_b, id_a, id_b, sim, confidence, sim >= 0.60 AND confidence >= 0.65 AS likely FROM (SELECT *, row_number() OVER (PARTITION BY cluster_a, cluster_b ORDER BY confidence DESC, id_a, id_b) AS n FROM q) WHERE n = 1"""


@query("k10_pose_bridges", K10, raw=True)
def bridges(v):
    """Anchors of clusters that were cut in four."""
    anchors = quarters(v).filter("quality_score >= 65").withColumn("pose", s.pose(F.col("yaw")))
    return k.pose_bridges(anchors)


@query("k16_merge_clusters", PLANTED + ", g AS (SELECT *, CASE WHEN cluster_id % 2 = 1 THEN cluster_id - 1 ELSE cluster_id END AS t FROM f) SELECT t AS cluster_id, face_id, n - 1 AS rank FROM (SELECT t, face_id, row_number() OVER (PARTITION BY t ORDER BY quality_score DESC, face_id) AS n FROM g) WHERE n <= 7", raw=True)
def merge_clusters(v):
    """Representatives after merging odd clusters into their even neighbours, the best ranked 0."""
    into = F.when(F.col("cluster_id") % 2 == 1, F.col("cluster_id") - 1).otherwise(F.col("cluster_id"))
    order = [F.col("quality_score").desc(), F.col("face_id")]
    kept = people.top_n(planted(v).withColumn("cluster_id", into), ["cluster_id"], order, 7)
    return people.compact_ranks(kept, ["cluster_id"], order).select("cluster_id", "face_id", "rank")


ODD_INTO_EVEN = PLANTED + """, u AS (SELECT cluster_id, n, list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) AS c FROM m),
w AS (SELECT cluster_id - cluster_id % 2 AS t, sum(n) AS n, list_transform(range(1, 65), lambda i: list_sum(list_transform(list(struct_pack(n := n, c := c)), lambda z: z.n * z.c[i])) / sum(n)) AS c FROM u GROUP BY 1)
"""


def merged(v):
    faces = saved(planted(v))
    middles = x.centroids(faces, "cluster_id", "v", normalize=True)
    moves = middles.filter("cluster_id % 2 = 1").select(F.col("cluster_id").alias("source"), (F.col("cluster_id") - 1).alias("target"))
    order = [F.col("quality_score").desc(), F.col("face_id")]
    held = people.compact_ranks(people.top_n(faces, ["cluster_id"], order, 7), ["cluster_id"], order)
    return k.merge_clusters(middles, faces, held.select("cluster_id", "face_id", "quality_score", "rank"), moves)


@query("k16_merged_rows", ODD_INTO_EVEN + "SELECT t AS cluster_id, n::BIGINT AS n, i - 1 AS pos, round(c[i] / sqrt(list_dot_product(c, c)), 6) AS value FROM w, (SELECT unnest(range(1, 65)) AS i)", raw=True)
def merged_rows(v):
    """Face counts and centroids of the clusters that are left."""
    return merged(v)["clusters"].select("cluster_id", "n", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", "n", "pos", F.round("x", 6).alias("value"))


@query("k16_merge_effects", PLANTED + """, g AS (SELECT *, cluster_id - cluster_id % 2 AS t, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, face_id) AS own FROM f),
r AS (SELECT t, face_id, row_number() OVER (PARTITION BY t ORDER BY quality_score DESC, face_id) AS n FROM g WHERE own <= 7)
SELECT 'FACE' AS kind, t AS cluster_id, face_id AS item, 0::BIGINT AS rank FROM g UNION ALL SELECT 'REPRESENTATIVE', t, face_id, n FROM r WHERE n <= 7 UNION ALL SELECT DISTINCT 'MERGE', t, cluster_id, 0 FROM g WHERE cluster_id % 2 = 1""", raw=True)
def merge_effects(v):
    """Where faces are now, the representatives kept of both clusters, ranked from 1, and a history row for each merge."""
    now, zero = merged(v), F.lit(0).cast("long").alias("rank")
    faces = now["faces"].select(F.lit("FACE").alias("kind"), "cluster_id", F.col("face_id").alias("item"), zero)
    kept = now["representatives"].select(F.lit("REPRESENTATIVE").alias("kind"), "cluster_id", F.col("face_id").alias("item"), F.col("rank").cast("long").alias("rank"))
    history = now["history"].select(F.col("operation").alias("kind"), "cluster_id", F.col("source_cluster_id").alias("item"), zero)
    return faces.unionByName(kept).unionByName(history)


K20 = "SELECT face_id, cluster_id, " + s.POSE_SQL.format(yaw="coalesce(euler_y, 0)") + " AS pose_category, 0 AS match_count FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL AND quality_score >= 65 AND sharpness_score >= 15 AND abs(euler_y) <= 20 AND eye_visibility_score >= 7 AND photo_id % 2 = 1"


@query("k20_promote_anchors", K20)
def promote(v):
    known = v.faces.filter("photo_id % 2 = 0").select("face_id")
    fit = v.faces.filter("NOT deleted AND cluster_id IS NOT NULL").filter(s.anchor_eligible("quality_score", "sharpness_score", "euler_y", "eye_visibility_score"))
    return fit.join(known, "face_id", "left_anti").select("face_id", "cluster_id", s.pose(F.coalesce("euler_y", F.lit(0))).alias("pose_category"), F.lit(0).alias("match_count"))


V11 = PLANTED + """, w AS (SELECT *, greatest(-0.08, least(0.08, (least(1, greatest(0, quality_score / 100)) - 0.5) * 0.2)) AS boost FROM f), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, face_id) AS n FROM f) WHERE n <= 7)
SELECT w.face_id, max(CASE WHEN r.n <= 3 THEN round(greatest(-1, least(1, list_dot_product(w.v, r.v) + boost)), 6) END) AS top3, max(round(greatest(-1, least(1, list_dot_product(w.v, r.v) + boost)), 6)) AS all_reps,
 max(CASE WHEN r.quality_score >= 65 THEN round(greatest(-1, least(1, list_dot_product(w.v, r.v) + boost)), 6) END) AS anchors FROM w JOIN r ON r.cluster_id = w.cluster_id GROUP BY 1"""


@query("v11_best_representative", V11, raw=True)
def best_representative(v):
    """Each face's best weighted similarity to its cluster's three best representatives, all seven, and those of anchor quality."""
    faces, order = planted(v), [F.col("quality_score").desc(), F.col("face_id")]
    top = people.compact_ranks(people.top_n(faces, ["cluster_id"], order, 7), ["cluster_id"], order)
    both = faces.join(top.select("cluster_id", F.col("v").alias("w"), "rank", F.col("quality_score").alias("q")), "cluster_id")
    sim = F.round(s.weighted_similarity(x.dot(F.col("v"), F.col("w")), F.col("quality_score")), 6)
    return both.groupBy("face_id").agg(F.max(F.when(F.col("rank") < 3, sim)).alias("top3"), F.max(sim).alias("all_reps"), F.max(F.when(F.col("q") >= 65, sim)).alias("anchors"))


V14 = PLANTED + """, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, face_id) AS n FROM f) WHERE n <= 20),
z AS (SELECT t.cluster_id, t.face_id, round(0.7 * list_dot_product(t.v, m.c) / sqrt(list_dot_product(m.c, m.c)) + 0.3 * t.quality_score / 100, 9) AS score FROM t JOIN m USING (cluster_id))
SELECT cluster_id, face_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, face_id) AS n FROM z) WHERE n = 1"""


@query("v14_representative", V14, raw=True)
def representative(v):
    faces = planted(v)
    middle = x.centroids(faces, "cluster_id", "v", normalize=True).select("cluster_id", "centroid")
    top = people.top_n(faces, ["cluster_id"], [F.col("quality_score").desc(), F.col("face_id")], 20).join(middle, "cluster_id")
    scored = top.withColumn("score", F.round(x.dot(F.col("v"), F.col("centroid")) * 0.7 + F.col("quality_score") / 100 * 0.3, 9))
    return people.best_per_group(scored, ["cluster_id"], [F.col("score").desc(), F.col("face_id")]).select("cluster_id", "face_id")


R4 = "SELECT (SELECT count(*) FROM v_clusters) AS base, (SELECT count(DISTINCT cluster_id) FROM v_faces WHERE cluster_id % 2 = 0) AS derived, (SELECT count(*) FROM v_clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM v_faces WHERE cluster_id % 2 = 0)) AS missing, 0::bigint AS orphaned, true AS rebuild"


@query("r4_sync_report", R4)
def sync_report(v):
    """How far a derived table is behind its base, and whether to rebuild it."""
    base, derived = v.clusters.select("cluster_id"), v.faces.filter("cluster_id % 2 = 0").select("cluster_id").distinct()
    both = base.withColumn("b", F.lit(1)).join(derived.withColumn("d", F.lit(1)), "cluster_id", "full_outer")
    out = both.agg(F.count("b").alias("base"), F.count("d").alias("derived"), F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("orphaned"))
    return out.withColumn("rebuild", (F.col("missing") > F.col("base") * 0.1) | (F.col("orphaned") > 10))


J11 = "SELECT i.image_id, o.n_nationkey AS overlay_id FROM (SELECT image_id, row_number() OVER (PARTITION BY album_id ORDER BY date_taken, image_id) - 1 AS pos FROM v_images) i JOIN nation o ON o.n_nationkey % 5 = 0 OR o.n_nationkey = i.pos"


@query("j11_overlays", J11)
def overlays(v):
    """Overlays shown on all images (five, fixed with the table) and those of one position."""
    place = F.row_number().over(W.partitionBy("album_id").orderBy("date_taken", "image_id")) - 1
    images = v.images.select("image_id", place.alias("pos"))
    marks = v.table("nation").select(F.col("n_nationkey").alias("overlay_id"))
    always = marks.filter("overlay_id % 5 = 0").agg(F.sort_array(F.collect_list("overlay_id")).alias("always"))
    # One row, whose list is the handful of overlays without a position.
    everywhere = images.join(F.broadcast(always), F.lit(True)).select("image_id", F.explode("always").alias("overlay_id"))
    return everywhere.unionByName(images.join(marks.filter("overlay_id % 5 <> 0"), F.col("pos") == F.col("overlay_id")).select("image_id", "overlay_id"))


M2 = """
, s AS (SELECT album_id, count(*) AS n, date_diff('day', min(date_taken)::date, max(date_taken)::date) AS days, count(DISTINCT place_name) AS places FROM v_images GROUP BY 1),
t(story, template, longest) AS (VALUES ('CELEBRATION', 'party', 3.0), ('CELEBRATION', 'lights', 2.0), ('TRAVEL', 'map', 4.0), ('MEMORIES', 'album', 5.0), ('MEMORIES', 'film', 3.0), ('SOCIAL', 'quick', 2.0)),
y AS (SELECT *, CASE WHEN days <= 1 AND n >= 5 THEN 'CELEBRATION' WHEN days > 2 AND places >= 2 THEN 'TRAVEL' WHEN days > 30 THEN 'MEMORIES' WHEN n <= 5 THEN 'SOCIAL' ELSE 'MEMORIES' END AS story FROM s)
SELECT album_id, story, (SELECT template FROM t WHERE t.story = y.story ORDER BY CASE WHEN n > 10 THEN longest ELSE 0 END, CASE template WHEN 'party' THEN 0 WHEN 'lights' THEN 1 WHEN 'album' THEN 0 ELSE 1 END LIMIT 1) AS template FROM y
"""
TEMPLATES = (("CELEBRATION", "party", 3.0, 0), ("CELEBRATION", "lights", 2.0, 1), ("TRAVEL", "map", 4.0, 0), ("MEMORIES", "album", 5.0, 0), ("MEMORIES", "film", 3.0, 1), ("SOCIAL", "quick", 2.0, 0))


@query("m2_story_plan", M2)
def story_plan(v):
    """A template for each album's story: the shortest for long albums, else the first."""
    from kithgraph.operators import sequence

    table = v.spark.createDataFrame(TEMPLATES, "story string, template string, longest double, place int")
    # Six rows.
    both = sequence.story_profile(v.images).join(F.broadcast(table), "story")
    order = [F.when(F.col("n") > 10, F.col("longest")).otherwise(0.0), F.col("place")]
    return people.best_per_group(both, ["album_id"], order).select("album_id", "story", "template")


@query("m12_recommend_tracks", "SELECT p_type AS mood, p_partkey AS track_id FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n <= 5", raw=True)
def recommend(v):
    tracks = v.table("part").select(F.col("p_type").alias("mood"), F.col("p_partkey").alias("track_id"))
    return people.top_n(tracks, ["mood"], [F.col("track_id")], 5)


M12B = """
WITH a AS (SELECT s_suppkey AS album_id, CASE WHEN s_suppkey % 4 <> 0 THEN p_type END AS mood FROM supplier LEFT JOIN part ON p_partkey = s_suppkey),
t AS (SELECT p_partkey AS track_id, p_type AS mood, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n, row_number() OVER (ORDER BY md5(concat('7-', p_partkey)), p_partkey) AS any_n FROM part)
SELECT album_id, track_id, n AS rank FROM a JOIN t ON a.mood = t.mood AND n <= 5 UNION ALL SELECT album_id, track_id, any_n FROM a JOIN t ON a.mood IS NULL AND any_n <= 5
"""


@query("m12_tracks_of_albums", M12B, raw=True)
def tracks_of_albums(v):
    """The first five tracks of each album's mood; albums without one get five by chance, the same for a seed."""
    parts = v.table("part").select(F.col("p_partkey").alias("track_id"), F.col("p_type").alias("mood"))
    albums = v.table("supplier").select(F.col("s_suppkey").alias("album_id")).join(parts, F.col("album_id") == F.col("track_id"), "left")
    albums = albums.select("album_id", F.when(F.col("album_id") % 4 != 0, F.col("mood")).alias("mood"))
    first = people.compact_ranks(people.top_n(parts, ["mood"], [F.col("track_id")], 5), ["mood"], [F.col("track_id")]).select("mood", "track_id", (F.col("rank") + 1).alias("rank"))
    chance = F.md5(F.concat(F.lit("7-"), F.col("track_id").cast("string")))
    drawn = parts.withColumn("chance", chance).orderBy("chance", "track_id").limit(5)
    # Five rows.
    lot = drawn.agg(F.sort_array(F.collect_list(F.struct("chance", "track_id"))).alias("lot"))
    other = albums.filter("mood IS NULL").join(F.broadcast(lot), F.lit(True)).select("album_id", F.posexplode("lot").alias("place", "x"))
    return albums.join(first, "mood").select("album_id", "track_id", "rank").unionByName(other.select("album_id", "x.track_id", (F.col("place") + 1).alias("rank")))


STORY_ROWS = M2[: M2.rindex("SELECT album_id")].rstrip()
M2B = STORY_ROWS + """,
k(story, track) AS (VALUES ('CELEBRATION', 'bright'), ('TRAVEL', 'road'), ('MEMORIES', 'piano'), ('SOCIAL', 'beat')),
c AS (SELECT y.album_id, y.n, y.story, k.track, (SELECT (template, longest) FROM t WHERE t.story = y.story ORDER BY CASE WHEN n > 10 THEN longest ELSE 0 END, CASE template WHEN 'party' THEN 0 WHEN 'lights' THEN 1 WHEN 'album' THEN 0 ELSE 1 END LIMIT 1) AS x FROM y JOIN k USING (story))
SELECT i.album_id, image_id, row_number() OVER (PARTITION BY i.album_id ORDER BY date_taken, image_id) - 1 AS place, c.x[1] AS template, c.track, round(least(c.x[2]::double, greatest(1, least(5, 60::double / n))), 6) AS seconds FROM v_images i JOIN c ON c.album_id = i.album_id
"""
TRACKS = (("CELEBRATION", "bright"), ("TRAVEL", "road"), ("MEMORIES", "piano"), ("SOCIAL", "beat"))


@query("m2_story_images", M2B)
def story_images(v):
    """Every image in its story: place by date, the album's template and track, and its seconds."""
    from kithgraph.operators import sequence

    table = v.spark.createDataFrame(TEMPLATES, "story string, template string, longest double, place int")
    tracks = v.spark.createDataFrame(TRACKS, "story string, track string")
    # Six rows and four.
    both = sequence.story_profile(v.images).join(F.broadcast(table), "story").join(F.broadcast(tracks), "story")
    order = [F.when(F.col("n") > 10, F.col("longest")).otherwise(0.0), F.col("place")]
    plan = people.best_per_group(both, ["album_id"], order).select("album_id", "template", "track", F.round(F.least("longest", s.clamp(60.0 / F.col("n"), 1, 5)), 6).alias("seconds"))
    place = F.row_number().over(W.partitionBy("album_id").orderBy("date_taken", "image_id")) - 1
    return v.images.select("album_id", "image_id", place.alias("place")).join(plan, "album_id").select("album_id", "image_id", "place", "template", "track", "seconds")


M4B = STORY_ROWS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY date_taken, image_id) - 1 AS place FROM v_images),
g AS (SELECT *, lag(place_name) OVER (PARTITION BY album_id ORDER BY date_taken, image_id) AS b FROM o WHERE place_name IS NOT NULL)
SELECT album_id, place, 'TITLE' AS style, CASE story WHEN 'TRAVEL' THEN coalesce('Adventures in ' || place_name, 'Travel Memories') WHEN 'CELEBRATION' THEN coalesce('Memories of ' || year(date_taken), 'Celebration') ELSE 'Our Memories' END AS caption FROM o JOIN y USING (album_id) WHERE place = 0 AND story <> 'SOCIAL'
UNION ALL SELECT album_id, place, 'CAPTION', place_name FROM g JOIN y USING (album_id) WHERE story = 'TRAVEL' AND (b IS NULL OR b <> place_name)
"""


@query("m4_story_captions", M4B)
def story_captions(v):
    """A title on each story's first image, and on travels the place wherever it differs from the last known one."""
    from kithgraph.operators import sequence

    return sequence.story_captions(v.images)


@query("e20_landmarks", scores.E20 + "SELECT face_id, verdict, round(geometry, 6) AS geometry, round(CASE WHEN verdict = 'VALID' THEN greatest(0, least(1, 0.4 * (1 - least(1, abs(slant) / 35)) + 0.3 * (1 - least(1, abs(log2(greatest(0.3, least(3, sqrt(0.31462 * 0.31462 + 0.00174 * 0.00174) * 112 / dist)))))) + 0.3 * geometry)) ELSE 0.3 END, 6)::DOUBLE AS alignment FROM lm")
def landmarks(v):
    """On pictures of 140 x 112; no nose was found on every sixth photo."""
    found = imaging.landmark_check(140, 112)
    return scores.landmark_points(v).select("face_id", found["verdict"].alias("verdict"), *(F.round(found[c], 6).alias(c) for c in ("geometry", "alignment")))


Q1 = """WITH p AS (SELECT vec_id AS image_id, list_transform(embedding, lambda e: trunc((e + 1::FLOAT) * 127::FLOAT)::INT) AS x FROM embeddings),
l AS (SELECT image_id, x, list_transform(list_filter(range(1, 65), lambda i: (i - 1) % 8 BETWEEN 1 AND 6 AND (i - 1) // 8 BETWEEN 1 AND 6), lambda i: x[i - 1] + x[i + 1] + x[i - 8] + x[i + 8] - 4 * x[i]) AS d FROM p)
SELECT image_id, round(list_var_pop(d), 6) AS variance, round(list_avg(x), 6) AS brightness, list_min(x)::double AS darkest, list_max(x)::double AS lightest FROM l"""


@query("q1_measure_images", Q1, raw=True)
def measure(v):
    """Sharpness and brightness of small pictures made from the embeddings' values."""
    found = imaging.measure_images(v.table("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), imaging.levels("embedding").alias("pixels")))
    return found.withColumns({c: F.round(c, 6) for c in ("variance", "brightness")})
