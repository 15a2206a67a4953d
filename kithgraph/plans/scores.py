"""Scores, tiers and formats: one expression a rule."""

from pyspark.sql import functions as F

from kithgraph.functions import scoring as s
from kithgraph.operators import imaging, people, sequence
from kithgraph.plans.catalog import query


@query("e1_quality_tier", "SELECT face_id, quality_tier AS tier FROM v_faces")
def tier(v):
    return v.faces.select("face_id", s.quality_tier("quality_score", "sharpness_score", "eye_visibility_score").alias("tier"))


ELIGIBLE = "quality_score >= 65 AND sharpness_score >= 15 AND coalesce(abs(yaw), {null}) <= 20 AND eye_visibility_score >= 7"
YAWS = ", y AS (SELECT *, CASE WHEN photo_id % 5 = 0 THEN NULL ELSE euler_y END AS yaw FROM v_faces) "


@query("e2_anchor_eligibility", YAWS + f"SELECT face_id, {ELIGIBLE.format(null=45)} AS strict, {ELIGIBLE.format(null=0)} AS lenient FROM y")
def eligible(v):
    faces = v.faces.withColumn("yaw", F.expr("CASE WHEN photo_id % 5 <> 0 THEN euler_y END"))
    rule = [s.anchor_eligible("quality_score", "sharpness_score", "yaw", "eye_visibility_score", x) for x in ("fail", "pass")]
    return faces.select("face_id", rule[0].alias("strict"), rule[1].alias("lenient"))


@query("e3_tier_flags", "SELECT face_id, quality_tier = 'ANCHOR' AS can_form, quality_tier IN ('ANCHOR', 'CLUSTERING') AS can_join, quality_tier IN ('ANCHOR', 'CLUSTERING') AS can_update_centroid, quality_tier <> 'REJECTED' AS stored, quality_tier <> 'REJECTED' AS visible FROM v_faces")
def flags(v):
    return v.faces.select("face_id", *[c.alias(n) for n, c in s.tier_flags("quality_tier").items()])


@query("e4_pose", "SELECT face_id, CASE WHEN abs(euler_y) <= 15 THEN 'FRONTAL' WHEN abs(euler_y) <= 35 THEN CASE WHEN euler_y < 0 THEN 'SLIGHT_LEFT' ELSE 'SLIGHT_RIGHT' END WHEN euler_y < 0 THEN 'PROFILE_LEFT' ELSE 'PROFILE_RIGHT' END AS pose FROM v_faces")
def pose(v):
    return v.faces.select("face_id", s.pose(F.col("euler_y")).alias("pose"))


E5 = """
, pairs AS (SELECT a.cluster_id, a.anchor_id AS a_id, b.anchor_id AS b_id, a.pose_category AS a, b.pose_category AS b, a.quality_score / 200 AS sim
  FROM v_anchors a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, anchor_id) AS n FROM v_anchors) WHERE n = 1) b ON a.cluster_id = b.cluster_id AND a.anchor_id <> b.anchor_id)
SELECT a_id, b_id, round(greatest(0, least(1, sim + CASE WHEN a = b THEN 0.15 WHEN (a = 'FRONTAL' AND b LIKE 'SLIGHT%') OR (b = 'FRONTAL' AND a LIKE 'SLIGHT%') THEN 0.12
  WHEN (a = 'SLIGHT_LEFT' AND b = 'PROFILE_LEFT') OR (a = 'PROFILE_LEFT' AND b = 'SLIGHT_LEFT') OR (a = 'SLIGHT_RIGHT' AND b = 'PROFILE_RIGHT') OR (a = 'PROFILE_RIGHT' AND b = 'SLIGHT_RIGHT') THEN 0.08 ELSE 0.03 END)), 6) AS confidence
FROM pairs
"""


@query("e5_bridge_confidence", E5)
def bridge(v):
    """Each anchor's bridge to the best one of its cluster."""
    best = people.best_per_group(v.anchors, ["cluster_id"], [F.col("quality_score").desc(), F.col("anchor_id")])
    both = v.anchors.alias("a").join(best.alias("b"), (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.anchor_id") != F.col("b.anchor_id")))
    sure = s.bridge_confidence(F.col("a.quality_score") / 200, F.col("a.pose_category"), F.col("b.pose_category"))
    return both.select(F.col("a.anchor_id").alias("a_id"), F.col("b.anchor_id").alias("b_id"), F.round(sure, 6).alias("confidence"))


@query("e6_match_zone", "SELECT face_id, CASE WHEN match_score - 0.3 >= 0.62 THEN 'HIGH' WHEN match_score - 0.3 >= 0.52 THEN 'MEDIUM' WHEN match_score - 0.3 >= 0.42 THEN 'STAGED' ELSE 'NEW_CLUSTER' END AS zone FROM v_faces")
def zone(v):
    return v.faces.select("face_id", s.match_zone(F.col("match_score") - 0.3).alias("zone"))


@query("e7_three_zones", "SELECT face_id, CASE WHEN confidence >= 0.62 THEN 'SAFE_SAME' WHEN confidence - 0.2 >= 0.35 THEN 'UNCERTAIN' ELSE 'SAFE_DIFFERENT' END AS zone FROM v_faces WHERE confidence >= 0.62 OR confidence < 0.55 OR TRUE")
def zones(v):
    sim = F.when(F.col("confidence") >= 0.62, F.col("confidence")).otherwise(F.col("confidence") - 0.2)
    return v.faces.select("face_id", s.three_zones(sim).alias("zone"))


E8 = """
, t(source, safe_same, uncertain_low, pass2_high, pass2_multi, adjustment) AS (VALUES ('FACENET_512', 0.62, 0.35, 0.50, 0.45, 0.0), ('MOBILEFACENET_192', 0.58, 0.42, 0.52, 0.45, -0.05), ('HASH_FALLBACK', 0.85, 0.70, 0.85, 0.70, 0.20))
SELECT face_id, cast(safe_same AS double) AS safe_same, cast(uncertain_low AS double) AS uncertain_low, cast(pass2_high AS double) AS pass2_high, cast(pass2_multi AS double) AS pass2_multi, cast(adjustment AS double) AS adjustment FROM v_faces JOIN t ON embedding_source = source
"""


@query("e8_source_thresholds", E8)
def source_thresholds(v):
    table = v.spark.createDataFrame(s.SOURCES, "embedding_source string, safe_same double, uncertain_low double, pass2_high double, pass2_multi double, adjustment double")
    # Four rows.
    return v.faces.select("face_id", "embedding_source").join(F.broadcast(table), "embedding_source").drop("embedding_source")


@query("e9_adaptive_threshold", "SELECT cluster_id, CASE WHEN face_count >= 10 THEN 'MATURE' WHEN face_count >= 5 THEN 'GROWING' ELSE 'NEW' END AS maturity, round(CASE WHEN face_count >= 10 THEN 0.47 WHEN face_count >= 5 THEN 0.52 ELSE 0.57 END, 6)::double AS threshold FROM v_clusters")
def adaptive(v):
    size = F.col("face_count")
    return v.clusters.select("cluster_id", s.maturity(size).alias("maturity"), F.round(s.adaptive_threshold(0.52, size), 6).alias("threshold"))


@query("e10_weighted_similarity", "SELECT face_id, CASE WHEN match_score IS NOT NULL THEN round(greatest(-1, least(1, match_score + greatest(-0.08, least(0.08, (least(1, greatest(0, quality_score / 100)) - 0.5) * 0.2)))), 6) END AS sim FROM v_faces")
def weighted(v):
    return v.faces.select("face_id", F.round(s.weighted_similarity(F.col("match_score"), F.col("quality_score")), 6).alias("sim"))


E11 = """
SELECT face_id, CASE WHEN confidence >= 0.62 THEN 'likely' WHEN confidence >= 0.58 THEN 'possible' ELSE 'uncertain' END AS label,
  round(least(0.3, greatest(0, confidence - 0.5)) / 0.3 * 0.3 + least(0.25, greatest(0, quality_score / 100 - 0.55)) / 0.25 * 0.7, 6) AS merge_confidence,
  round(least(0.15, greatest(0, bbox_left - 0.05)) / 0.15 * 0.4 + least(0.35, greatest(0, confidence - 0.25)) / 0.35 * 0.3 + CASE WHEN eye_visibility_score >= 3 THEN 0.3 WHEN eye_visibility_score = 2 THEN 0.21 ELSE 0.09 END, 6) AS split_confidence
FROM v_faces
"""


@query("e11_merge_split_confidence", E11)
def merge_split(v):
    return v.faces.select(
        "face_id",
        s.merge_label(F.col("confidence")).alias("label"),
        F.round(s.merge_confidence(F.col("confidence"), F.col("quality_score") / 100), 6).alias("merge_confidence"),
        F.round(s.split_confidence(F.col("bbox_left"), F.col("confidence"), F.col("eye_visibility_score")), 6).alias("split_confidence"),
    )


@query("e12_date_formats", "SELECT photo_id, strftime(date_taken, '%B %-d, %Y') AS friendly, strftime(date_taken, '%b %Y') AS month, strftime(date_taken, '%m-%d') AS day, strftime(date_taken, '%Y-%m-%d') AS day_key, strftime(date_taken, '%Y') AS year FROM v_photos")
def dates(v):
    return v.photos.select("photo_id", *[F.date_format("date_taken", f).alias(n) for f, n in (("MMMM d, yyyy", "friendly"), ("MMM yyyy", "month"), ("MM-dd", "day"), ("yyyy-MM-dd", "day_key"), ("yyyy", "year"))])


E13 = """
, tags AS (SELECT photo_id, CASE WHEN photo_id % 4 = 0 THEN 'bad' WHEN photo_id % 4 = 1 THEN NULL ELSE strftime(date_added, '%Y:%m:%d %H:%M:%S') END AS original, strftime(date_added, '%Y:01:%d %H:%M:%S') AS digitized FROM v_photos)
SELECT photo_id, try_strptime(coalesce(original, digitized), '%Y:%m:%d %H:%M:%S') AS taken FROM tags
"""


@query("e13_parse_dates", E13)
def parse_dates(v):
    """The first tag present is taken; if it can't be read there is no date."""
    original = F.when(F.col("photo_id") % 4 == 0, "bad").when(F.col("photo_id") % 4 == 1, None).otherwise(F.date_format("date_added", "yyyy:MM:dd HH:mm:ss"))
    first = F.coalesce(original, F.date_format("date_added", "yyyy:'01':dd HH:mm:ss"))
    return v.photos.select("photo_id", F.try_to_timestamp(first, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz").alias("taken"))


E14 = ", w AS (SELECT person_id, CASE WHEN person_id % 3 <> 0 THEN name END AS city, CASE WHEN person_id % 2 = 0 THEN 'Land' END AS country FROM v_persons) SELECT person_id, CASE WHEN city IS NOT NULL AND country IS NOT NULL THEN city || ', ' || country ELSE coalesce(city, country) END AS place FROM w"


@query("e14_place_name", E14)
def place(v):
    city, country = F.expr("CASE WHEN person_id % 3 <> 0 THEN name END"), F.expr("CASE WHEN person_id % 2 = 0 THEN 'Land' END")
    return v.persons.select("person_id", F.nullif(F.concat_ws(", ", city, country), F.lit("")).alias("place"))


E15 = "SELECT image_id, concat_ws(' • ', place_name, strftime(taken, '%B %-d, %Y')) AS full_caption, coalesce(place_name, '') AS location, coalesce(strftime(taken, '%B %-d, %Y'), '') AS date, coalesce(strftime(taken, '%b %Y'), '') AS minimal FROM (SELECT *, CASE WHEN image_id % 7 <> 0 THEN date_taken END AS taken FROM v_images)"


@query("e15_captions", E15)
def captions(v):
    """Every seventh image has no date."""
    images = v.images.withColumn("date_taken", F.when(F.col("image_id") % 7 != 0, F.col("date_taken")))
    styles = (("FULL", "full_caption"), ("LOCATION_ONLY", "location"), ("DATE_ONLY", "date"), ("MINIMAL", "minimal"))
    return images.select("image_id", *(sequence.caption(style).alias(name) for style, name in styles))


@query("e16_clock", "SELECT image_id, (floor(duration_s / 60))::int || ':' || lpad((floor(duration_s % 60))::int::varchar, 2, '0') AS shown FROM v_images WHERE duration_s IS NOT NULL")
def clock(v):
    return v.images.filter("duration_s IS NOT NULL").select("image_id", s.clock(F.col("duration_s")).alias("shown"))


@query("e17_durations", "SELECT cluster_id, round(greatest(1.0, least(5.0, 60.0 / face_count)), 6)::double AS smart, round(least(greatest(CASE WHEN face_count <= 5 THEN 30.0 WHEN face_count <= 10 THEN 45.0 ELSE 60.0 END / face_count, 1.0), 4.0), 6)::double AS optimal FROM v_clusters WHERE face_count > 0")
def durations(v):
    own = v.clusters.filter("face_count > 0")
    return own.select("cluster_id", F.round(s.clamp(60.0 / F.col("face_count"), 1, 5), 6).alias("smart"), F.round(s.optimal_duration(F.col("face_count"), F.lit(4.0)), 6).alias("optimal"))


E18 = """
SELECT face_id, CASE WHEN px >= 200 THEN 25 WHEN px >= 150 THEN 22 WHEN px >= 100 THEN 18 WHEN px >= 80 THEN 14 WHEN px >= 60 THEN 8 WHEN px >= 40 THEN 4 ELSE 0 END::double AS size_score,
 round(greatest(0, least(25, 25 - CASE WHEN abs(euler_y) > 45 THEN 20 WHEN abs(euler_y) > 30 THEN 10 + (abs(euler_y) - 30) * 0.4 WHEN abs(euler_y) > 15 THEN 3 + (abs(euler_y) - 15) * 0.3 ELSE abs(euler_y) * 0.1 END
 - CASE WHEN roll > 35 THEN 10 WHEN roll > 25 THEN 5 + (roll - 25) * 0.3 ELSE roll * 0.1 END)), 6)::double AS pose_score
FROM (SELECT face_id, euler_y, quality_score * 2.2 AS px, abs(euler_y) / 2.0 AS roll FROM v_faces)
"""


@query("e18_size_pose_scores", E18)
def size_pose(v):
    yaw = F.col("euler_y")
    return v.faces.select("face_id", s.size_score(F.col("quality_score") * 2.2).alias("size_score"), F.round(s.pose_score(yaw, yaw / 2), 6).alias("pose_score"))


#: A face's box on a picture of 640 x 480, drawn from the view's shares, a little over the edge for some.
BOX = ", bx AS (SELECT face_id, bbox_left * 640 - 30 AS l, bbox_top * 480 - 5 AS t, bbox_right * 640 - 30 AS r, bbox_bottom * 480 - 5 AS b FROM v_faces)"
E19 = BOX + """, g AS (SELECT *, r - l AS w, b - t AS h, (greatest(least(r, 640) - greatest(l, 0), 0) * greatest(least(b, 480) - greatest(t, 0), 0)) AS inside FROM bx),
k AS (SELECT *, 1 - inside / (w * h) AS clip FROM g WHERE w >= 50 AND h >= 50 AND w / h BETWEEN 0.5 AND 2)
SELECT face_id, round(clip, 6) AS clip, round(greatest(0, least(1, l / 640)), 6)::double AS norm_left, round(greatest(0, least(1, r / 640)), 6)::double AS norm_right, greatest(trunc(l - w * 0.25), 0)::int AS crop_left, greatest(trunc(t - h * 0.25), 0)::int AS crop_top, least(trunc(r + w * 0.25), 640)::int AS crop_right, least(trunc(b + h * 0.25), 480)::int AS crop_bottom FROM k WHERE round(clip, 9) <= 0.20"""


def boxes(v):
    return v.faces.select("face_id", (F.col("bbox_left") * 640 - 30).alias("l"), (F.col("bbox_top") * 480 - 5).alias("t"), (F.col("bbox_right") * 640 - 30).alias("r"), (F.col("bbox_bottom") * 480 - 5).alias("b"))


@query("e19_geometry_filter", E19)
def geometry(v):
    return s.usable_boxes(boxes(v), 640, 480)


E18B = BOX + """, p AS (SELECT face_id, ((1 - (abs((l + r) / 2 / 640 - 0.5) + abs((t + b) / 2 / 480 - 0.5))) * 5) AS mid, l / 640 < 0.03 OR t / 480 < 0.03 OR (640 - r) / 640 < 0.03 OR (480 - b) / 480 < 0.03 AS edge FROM bx),
y AS (SELECT face_id, eye_visibility_score / 11.0 AS le, CASE WHEN photo_id % 3 = 0 THEN NULL ELSE sharpness_score / 26.0 END AS re, quality_score * 0.5 AS apart FROM v_faces)
SELECT p.face_id, (CASE WHEN edge THEN 0 ELSE round(greatest(0, least(5, mid)), 6) END)::double AS position, (least(10, 3 + CASE WHEN le > 0.8 THEN 2 WHEN le > 0.5 THEN 1.5 WHEN le > 0.3 THEN 0.5 ELSE 0 END + CASE WHEN re IS NULL THEN 1 WHEN re > 0.8 THEN 2 WHEN re > 0.5 THEN 1.5 WHEN re > 0.3 THEN 0.5 ELSE 0 END
 + CASE WHEN apart > 30 THEN 2 WHEN apart > 20 THEN 1.5 WHEN apart > 10 THEN 1 ELSE 0 END))::double AS eyes FROM p JOIN y USING (face_id)"""


@query("e18_eye_position_scores", E18B)
def eye_position(v):
    faces = v.faces.select("face_id", (F.col("eye_visibility_score") / 11.0).alias("le"), F.when(F.col("photo_id") % 3 != 0, F.col("sharpness_score") / 26.0).alias("re"), (F.col("quality_score") * 0.5).alias("apart"))
    both = boxes(v).join(faces, "face_id")
    return both.select("face_id", F.round(s.position_score(F.col("l"), F.col("t"), F.col("r"), F.col("b"), 640, 480), 6).alias("position"), s.eye_score(F.col("le"), F.col("re"), F.col("apart")).alias("eyes"))


E21 = """
, m AS (SELECT face_id, quality_score * quality_score / 15 AS va, quality_score * 2.5 AS br, sharpness_score * 7 AS co FROM v_faces)
SELECT face_id, round(CASE WHEN va >= 500 THEN 25 WHEN va >= 300 THEN 22 + (va - 300) / 66 WHEN va >= 150 THEN 18 + (va - 150) / 37.5 WHEN va >= 80 THEN 12 + (va - 80) / 11.7 WHEN va >= 40 THEN 6 + (va - 40) / 6.7 WHEN va >= 15 THEN 2 + (va - 15) / 6.25 ELSE va / 7.5 END, 6)::double AS sharpness,
 (CASE WHEN br >= 100 AND br <= 160 THEN 10 WHEN br >= 80 AND br <= 180 THEN 8 WHEN br >= 60 AND br <= 200 THEN 5 WHEN br >= 40 AND br <= 220 THEN 3 WHEN br < 30 OR br > 230 THEN 0 ELSE 1 END
 + CASE WHEN co >= 150 THEN 5 WHEN co >= 100 THEN 4 WHEN co >= 70 THEN 3 WHEN co >= 40 THEN 2 ELSE 0 END)::double AS brightness FROM m
"""


@query("e21_measured_scores", E21)
def measured(v):
    q = F.col("quality_score")
    return v.faces.select("face_id", F.round(s.sharpness_score(q * q / 15), 6).alias("sharpness"), s.brightness_score(q * 2.5, F.col("sharpness_score") * 7).alias("brightness"))


E20 = """
, l AS (SELECT face_id, 20.0 + sharpness_score AS lx, 30.0 AS ly, 50.0 + quality_score AS rx, 30.0 + eye_visibility_score AS ry, CASE WHEN photo_id % 6 <> 0 THEN 40.0 + quality_score / 2 END AS nx, 40.0 + eye_visibility_score * 4 AS ny FROM v_faces),
d AS (SELECT *, sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly)) AS dist, atan2(ry - ly, rx - lx) * 180 / pi() AS slant FROM l),
lg AS (SELECT *, (ny - (ly + ry) / 2) / dist AS ratio, abs(nx - (lx + rx) / 2) / dist AS off FROM d),
lv AS (SELECT *, CASE WHEN rx > 140 OR lx > 140 OR ly > 112 OR ry > 112 THEN 'OUT_OF_BOUNDS' WHEN dist < 20 THEN 'EYES_TOO_CLOSE' WHEN abs(slant) > 30 THEN 'EXTREME_POSE' WHEN nx IS NOT NULL AND (ratio < 0.3 OR ratio > 2) THEN 'INVALID_GEOMETRY' WHEN nx IS NOT NULL AND off > 0.5 THEN 'EXTREME_POSE' ELSE 'VALID' END AS verdict FROM lg),
lm AS (SELECT *, CASE WHEN verdict <> 'VALID' THEN 0 WHEN nx IS NULL THEN 0.7 ELSE greatest(0, least(1, (1 - least(1, abs(ratio - 0.8) / 0.8)) * (1 - off * 2))) END::DOUBLE AS geometry FROM lv)
"""


def landmark_points(v):
    """Eyes and nose of every face; without a nose on every sixth photo."""
    return v.faces.select(
        "face_id", (20.0 + F.col("sharpness_score")).alias("lx"), F.lit(30.0).alias("ly"), (50.0 + F.col("quality_score")).alias("rx"), (30.0 + F.col("eye_visibility_score")).alias("ry"),
        F.when(F.col("photo_id") % 6 != 0, 40.0 + F.col("quality_score") / 2).alias("nx"), (40.0 + F.col("eye_visibility_score") * 4).alias("ny"),
    )


Q3 = E19[: E19.rindex("SELECT face_id, round(clip")] + E20 + """
, m AS (SELECT *, quality_score * 2.2 AS px, quality_score * quality_score / 15 AS va, quality_score * 2.5 AS br, sharpness_score * 7 AS co FROM v_faces),
o AS (SELECT face_id, sharpness_score, eye_visibility_score, CASE WHEN px >= 200 THEN 25 WHEN px >= 150 THEN 22 WHEN px >= 100 THEN 18 WHEN px >= 80 THEN 14 WHEN px >= 60 THEN 8 WHEN px >= 40 THEN 4 ELSE 0 END
 + greatest(0, least(25, 25 - CASE WHEN abs(euler_y) > 45 THEN 20 WHEN abs(euler_y) > 30 THEN 10 + (abs(euler_y) - 30) * 0.4 WHEN abs(euler_y) > 15 THEN 3 + (abs(euler_y) - 15) * 0.3 ELSE abs(euler_y) * 0.1 END
   - CASE WHEN abs(euler_y) / 2 > 35 THEN 10 WHEN abs(euler_y) / 2 > 25 THEN 5 + (abs(euler_y) / 2 - 25) * 0.3 ELSE abs(euler_y) / 2 * 0.1 END))
 + CASE WHEN va >= 500 THEN 25 WHEN va >= 300 THEN 22 + (va - 300) / 66 WHEN va >= 150 THEN 18 + (va - 150) / 37.5 WHEN va >= 80 THEN 12 + (va - 80) / 11.7 WHEN va >= 40 THEN 6 + (va - 40) / 6.7 WHEN va >= 15 THEN 2 + (va - 15) / 6.25 ELSE va / 7.5 END
 + CASE WHEN br >= 100 AND br <= 160 THEN 10 WHEN br >= 80 AND br <= 180 THEN 8 WHEN br >= 60 AND br <= 200 THEN 5 WHEN br >= 40 AND br <= 220 THEN 3 WHEN br < 30 OR br > 230 THEN 0 ELSE 1 END
 + CASE WHEN co >= 150 THEN 5 WHEN co >= 100 THEN 4 WHEN co >= 70 THEN 3 WHEN co >= 40 THEN 2 ELSE 0 END + eye_visibility_score AS raw FROM m),
c AS (SELECT *, round(greatest(0, least(100, raw)), 6)::double AS overall FROM o), z AS (SELECT *, """ + s.TIER_SQL.format(score="overall", sharpness="sharpness_score", eye="eye_visibility_score") + """ AS tier FROM c)
SELECT face_id, overall, tier FROM z WHERE tier <> 'REJECTED' AND face_id IN (SELECT face_id FROM k WHERE round(clip, 9) <= 0.20) AND face_id IN (SELECT face_id FROM lm WHERE verdict = 'VALID')
"""


@query("q3_score_faces", Q3)
def score_faces(v):
    """Overall score and tier from the five measured parts, of faces with a usable box and usable landmarks; rejects go."""
    yaw, q = F.col("euler_y"), F.col("quality_score")
    parts = s.size_score(q * 2.2) + s.pose_score(yaw, yaw / 2) + s.sharpness_score(q * q / 15) + s.brightness_score(q * 2.5, F.col("sharpness_score") * 7) + F.col("eye_visibility_score")
    # Exploding an array of one keeps the optimiser from writing the sum into every branch of the tier.
    usable = s.usable_boxes(boxes(v), 640, 480).select("face_id")
    sound = landmark_points(v).filter(imaging.landmark_check(140, 112)["verdict"] == "VALID").select("face_id")
    faces = v.faces.join(usable, "face_id", "left_semi").join(sound, "face_id", "left_semi")
    scored = faces.select("face_id", F.explode(F.array(F.round(s.clamp(parts, 0, 100), 6).cast("double"))).alias("overall"), "sharpness_score", "eye_visibility_score")
    tier = s.quality_tier("overall", "sharpness_score", "eye_visibility_score")
    return scored.select("face_id", "overall", tier.alias("tier")).filter("tier <> 'REJECTED'")
