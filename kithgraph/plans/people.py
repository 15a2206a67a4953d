"""People-and-photo queries: joins, grouped counts, best-of-group picks, constraints and upkeep."""

from pyspark.sql import functions as F

from kithgraph.operators import people as p
from kithgraph.operators import tables as t
from kithgraph.plans.catalog import query

PERSON_FACES = ", pf AS (SELECT f.*, c.person_id FROM v_faces f JOIN v_clusters c USING (cluster_id) WHERE NOT f.deleted AND NOT c.deleted)\n"
AREA = "(df.bbox_right - df.bbox_left) * (df.bbox_bottom - df.bbox_top)"

W1 = f"""
SELECT p.person_id, p.name, p.photo_count, f.face_id, f.photo_id
FROM v_persons p JOIN v_clusters c ON c.person_id = p.person_id AND NOT c.deleted
JOIN v_faces f ON f.cluster_id = c.cluster_id AND NOT f.deleted
WHERE NOT p.is_hidden AND NOT p.deleted AND f.face_id = (
  SELECT df.face_id FROM v_faces df JOIN v_clusters c2 ON df.cluster_id = c2.cluster_id
  WHERE c2.person_id = p.person_id AND NOT df.deleted AND NOT c2.deleted AND df.quality_tier IN ('ANCHOR', 'CLUSTERING')
  ORDER BY df.quality_score DESC, coalesce(df.match_score, 0) DESC, {AREA} DESC, df.face_id LIMIT 1)
"""


@query("w1_persons_with_face", W1)
def persons_with_face(v):
    return p.persons_with_face(v.persons, v.clusters, v.faces)


@query("j1_person_faces", PERSON_FACES + "SELECT person_id, face_id, photo_id, match_score FROM pf WHERE person_id IS NOT NULL")
def person_faces(v):
    return p.person_faces(v.faces, v.clusters).filter("person_id IS NOT NULL").select("person_id", "face_id", "photo_id", "match_score")


@query("j2_photos_of_person", PERSON_FACES + "SELECT person_id, photo_id, max(coalesce(match_score, 0)) AS best_match, max(confidence) AS best_confidence FROM pf WHERE person_id IS NOT NULL GROUP BY 1, 2")
def photos_of_person(v):
    return p.photos_of_person(v.faces, v.clusters)


SOLO = PERSON_FACES + "SELECT DISTINCT a.person_id, a.photo_id FROM pf a WHERE a.person_id IS NOT NULL AND a.photo_id NOT IN (SELECT b.photo_id FROM pf b WHERE b.person_id <> a.person_id AND b.photo_id = a.photo_id)"


@query("j3_solo_photos", SOLO)
def solo_photos(v):
    return p.solo_photos(v.faces, v.clusters)


@query("j4_photos_with_all", PERSON_FACES + "SELECT photo_id FROM pf WHERE person_id IN (17, 94) GROUP BY 1 HAVING count(DISTINCT person_id) = 2")
def photos_with_all(v):
    return p.photos_with_all(v.faces, v.clusters, [17, 94, 17])


J6 = "SELECT coalesce(f.cluster_id, c.cluster_id) AS cluster_id, CASE WHEN c.cluster_id IS NULL THEN 'orphaned' ELSE 'missing' END AS side FROM (SELECT DISTINCT cluster_id FROM v_faces WHERE cluster_id % 2 = 0) f FULL JOIN v_clusters c ON f.cluster_id = c.cluster_id WHERE f.cluster_id IS NULL OR c.cluster_id IS NULL"


@query("j6_diff_keys", J6)
def diff_keys(v):
    return p.diff_keys(v.clusters.select("cluster_id"), v.faces.filter("cluster_id % 2 = 0").select("cluster_id").distinct(), "cluster_id")


@query("j7_photo_pairs", "SELECT a.photo_id, a.face_id AS face_a, b.face_id AS face_b FROM v_faces a JOIN v_faces b ON a.photo_id = b.photo_id AND a.face_id < b.face_id WHERE NOT a.deleted AND NOT b.deleted")
def photo_pairs(v):
    pairs = p.pairs_within(t.live(v.faces).select("photo_id", "face_id"), "photo_id", "face_id")
    return pairs.select("photo_id", F.col("a.face_id").alias("face_a"), F.col("b.face_id").alias("face_b"))


@query("a1_table_counts", "SELECT (SELECT count(*) FROM v_faces WHERE NOT deleted) AS faces, (SELECT count(*) FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL) AS clustered, (SELECT count(*) FROM v_persons WHERE NOT deleted AND NOT is_hidden) AS visible_persons, (SELECT count(*) FROM v_photos WHERE scan_status = 'PENDING') AS pending")
def table_counts(v):
    return p.table_counts(v.faces, v.persons, v.photos)


@query("a2_faces_per_cluster", "SELECT cluster_id, count(*) AS n FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL GROUP BY 1")
def faces_per_cluster(v):
    return p.counts_by(t.live(v.faces).filter("cluster_id IS NOT NULL"), "cluster_id")


@query("a2_faces_per_person", PERSON_FACES + "SELECT person_id, count(*) AS n FROM pf WHERE person_id IS NOT NULL GROUP BY 1")
def faces_per_person(v):
    return p.counts_by(p.person_faces(v.faces, v.clusters).filter("person_id IS NOT NULL"), "person_id")


@query("a3_photos_per_cluster", "SELECT cluster_id, count(DISTINCT photo_id) AS photos FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL GROUP BY 1")
def photos_per_cluster(v):
    return p.distinct_counts(t.live(v.faces).filter("cluster_id IS NOT NULL"), "cluster_id", "photo_id", "photos")


A4 = PERSON_FACES + "SELECT person_id, CASE WHEN deleted THEN photo_count ELSE (SELECT count(DISTINCT photo_id) FROM pf WHERE pf.person_id = p.person_id) END AS photo_count FROM v_persons p"


@query("a4_recount_photos", A4)
def recount(v):
    return p.recount_photos(v.persons, v.faces, v.clusters).select("person_id", "photo_count")


@query("a5_groups_with_min", "SELECT cluster_id, count(*) AS n FROM v_anchors WHERE is_active GROUP BY 1 HAVING count(*) >= 2")
def groups_with_min(v):
    return p.counts_by(t.anchors(v.anchors), "cluster_id").filter("n >= 2")


@query("a6_average_threshold", "SELECT round(avg(acceptance_threshold), 6) AS threshold, round(avg(anchor_count), 6) AS anchors FROM v_statistics")
def averages(v):
    return v.statistics.agg(F.round(F.avg("acceptance_threshold"), 6).alias("threshold"), F.round(F.avg("anchor_count"), 6).alias("anchors"))


@query("a7_display_numbers", "SELECT person_id, coalesce(display_number, (SELECT max(display_number) FROM v_persons) + row_number() OVER (PARTITION BY display_number IS NULL ORDER BY person_id)) AS display_number FROM v_persons")
def display_numbers(v):
    return p.assign_display_numbers(v.persons.select("person_id", "display_number"))


A8 = "SELECT cluster_id, '{' || string_agg('\"' || pose_category || '\":' || n, ',' ORDER BY pose_category) || '}' AS poses FROM (SELECT cluster_id, pose_category, count(*) AS n FROM v_anchors WHERE is_active GROUP BY 1, 2) GROUP BY 1"


@query("a8_pose_distribution", A8)
def pose_distribution(v):
    return p.pose_distribution(t.anchors(v.anchors))


A10 = "SELECT embedding_source, count(*) AS n, 100 * count(*) // (SELECT count(*) FROM v_faces WHERE NOT deleted) AS percent, count(*) FILTER (photo_id % 5 <> 0) AS aligned, count(*) FILTER (photo_id % 5 = 0) AS not_aligned, count(*) FILTER (alignment_quality < 0.3) AS low FROM v_faces WHERE NOT deleted GROUP BY 1"


@query("a10_embedding_sources", A10)
def embedding_sources(v):
    """Faces of every fifth photo could not be aligned."""
    return p.embedding_source_stats(t.live(v.faces).withColumn("aligned", F.col("photo_id") % 5 != 0))


def best(order: str, where: str = "TRUE", key: str = "person_id", source: str = "pf") -> str:
    return f"SELECT {key}, face_id FROM (SELECT {key}, face_id, row_number() OVER (PARTITION BY {key} ORDER BY {order}, face_id) AS n FROM {source} WHERE {key} IS NOT NULL AND {where}) WHERE n = 1"


@query("w2_best_match_face", PERSON_FACES + best("coalesce(match_score, 0) DESC, confidence DESC"))
def best_match(v):
    return p.best_face(p.person_faces(v.faces, v.clusters), "match")


@query("w3_thumbnails", PERSON_FACES + best("(eye_visibility_score > 0) DESC, quality_score DESC, coalesce(match_score, 0) DESC"))
def thumbnails(v):
    return p.best_face(p.person_faces(v.faces, v.clusters), "thumbnail")


@query("w4_best_in_cluster", best("match_score DESC", "NOT deleted AND match_score IS NOT NULL", "cluster_id", "v_faces"))
def best_in_cluster(v):
    faces = t.live(v.faces).filter("match_score IS NOT NULL AND cluster_id IS NOT NULL")
    return p.best_per_group(faces, ["cluster_id"], [F.col("match_score").desc(), F.col("face_id")]).select("cluster_id", "face_id")


W5 = "SELECT cluster_id, pose_category, anchor_id FROM (SELECT *, rank() OVER (PARTITION BY cluster_id, pose_category ORDER BY quality_score DESC) AS n FROM v_anchors WHERE is_active) WHERE n = 1"


@query("w5_best_per_pose", W5)
def best_per_pose(v):
    return p.best_per_pose(t.anchors(v.anchors)).select("cluster_id", "pose_category", "anchor_id")


@query("w6_top_anchors", "SELECT cluster_id, anchor_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, anchor_id) AS n FROM v_anchors WHERE is_active) WHERE n <= 3")
def top_anchors(v):
    return p.top_n(t.anchors(v.anchors), ["cluster_id"], [F.col("quality_score").desc(), F.col("anchor_id")], 3).select("cluster_id", "anchor_id")


@query("w7_compact_ranks", "SELECT anchor_id, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, anchor_id) - 1 AS rank FROM v_anchors WHERE is_active")
def compact_ranks(v):
    return p.compact_ranks(t.anchors(v.anchors), ["cluster_id"], [F.col("quality_score").desc(), F.col("anchor_id")]).select("anchor_id", "rank")


@query("w8_backfill_numbers", "SELECT person_id, (SELECT count(*) FROM v_persons q WHERE NOT q.deleted AND q.created_at <= p.created_at) AS display_number FROM v_persons p WHERE NOT deleted")
def backfill(v):
    return p.backfill_display_number(t.live(v.persons).drop("display_number"))


@query("w9_reorder", "SELECT image_id, row_number() OVER (PARTITION BY album_id ORDER BY CASE WHEN image_id % 5 = 0 THEN 0 ELSE 1 END, date_taken, image_id) - 1 AS pos FROM v_images")
def reorder(v):
    order = [F.when(F.col("image_id") % 5 == 0, 0).otherwise(1), F.col("date_taken"), F.col("image_id")]
    return p.compact_ranks(v.images, ["album_id"], order, "pos").select("image_id", "pos")


W10 = """
, r AS (SELECT history_id, avg(value) OVER (PARTITION BY cluster_id ORDER BY ts, history_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rate, count(*) OVER (PARTITION BY cluster_id) - row_number() OVER (PARTITION BY cluster_id ORDER BY ts, history_id) AS waiting FROM v_history)
SELECT history_id, rate, 60000 / nullif(rate, 0) AS per_minute, rate * waiting / 1000 AS eta_s FROM (SELECT history_id, round(rate, 8) AS rate, waiting FROM r)
"""


@query("w10_scan_rate", W10)
def scan_rate(v):
    """Milliseconds a row over the last 50, rows a minute, and the seconds that the rows still waiting will take."""
    found = p.scan_rate(v.history, "cluster_id", ["ts", "history_id"], "value", 50).withColumn("rate", F.round("rate", 8))
    return found.select("history_id", "rate", (60000 / F.nullif("rate", F.lit(0.0))).alias("per_minute"), (F.col("rate") * F.col("waiting") / 1000).alias("eta_s"))


@query("w11_stable_order", "SELECT person_id, row_number() OVER (ORDER BY (person_id % 3 = 0), photo_count DESC, person_id) AS place FROM v_persons WHERE NOT deleted")
def stable_order(v):
    return p.stable_order(t.live(v.persons), v.persons.filter("person_id % 3 <> 0"))


@query("l4_photos_by_match", PERSON_FACES + "SELECT person_id, photo_id, max(coalesce(match_score, 0)) AS best_match FROM pf WHERE person_id = 17 GROUP BY 1, 2")
def photos_by_match(v):
    return p.photos_of_person(v.faces, v.clusters).filter("person_id = 17").drop("best_confidence").orderBy(F.col("best_match").desc(), "photo_id")


C1 = "SELECT DISTINCT least(a.face_id, b.face_id) AS face_id1, greatest(a.face_id, b.face_id) AS face_id2 FROM v_faces a JOIN v_faces b ON a.photo_id = b.photo_id AND a.face_id < b.face_id WHERE NOT a.deleted AND NOT b.deleted AND (a.photo_id % 4 <> 0)"


@query("c1_same_photo_constraints", C1)
def same_photo(v):
    faces = t.live(v.faces).select("photo_id", "face_id")
    existing = p.same_photo_constraints(faces.filter("photo_id % 4 = 0"), None)
    return p.same_photo_constraints(faces, existing)


C2 = """
, b AS (SELECT face_id1 AS face_id, face_id2 AS partner FROM v_constraints WHERE constraint_type = 'CANNOT_LINK' UNION SELECT face_id2, face_id1 FROM v_constraints WHERE constraint_type = 'CANNOT_LINK')
SELECT face_id, partner, count(*) OVER (PARTITION BY face_id) AS partners FROM b
"""


@query("c2_cannot_link_map", C2)
def cannot_link_map(v):
    """The map as rows, one for each face and partner, with the number of partners; a list could grow without bound."""
    both = t.partners(v.constraints, "CANNOT_LINK").select("face_id", "partner").distinct()
    return both.join(both.groupBy("face_id").agg(F.count("*").alias("partners")), "face_id")


C3 = "SELECT DISTINCT a.face_id, a.cluster_id, b.face_id AS partner FROM v_faces a JOIN v_faces b ON a.cluster_id = b.cluster_id AND a.photo_id = b.photo_id AND a.face_id <> b.face_id WHERE NOT a.deleted AND NOT b.deleted"


@query("c3_violations", C3)
def violations(v):
    faces = t.live(v.faces).select("face_id", "photo_id", "cluster_id")
    return p.violations(faces.filter("cluster_id IS NOT NULL"), p.same_photo_constraints(faces.select("photo_id", "face_id"), None))


@query("c4_add_constraints", "SELECT face_id1, face_id2, constraint_type FROM v_constraints WHERE constraint_type = 'MUST_LINK' UNION ALL SELECT 'a', 'b', 'CANNOT_LINK'")
def add_constraints(v):
    old = v.constraints.filter("constraint_type = 'MUST_LINK'")
    new = v.spark.range(2).select(F.when(F.col("id") == 0, "b").otherwise("a").alias("face_id1"), F.when(F.col("id") == 0, "a").otherwise("b").alias("face_id2"), F.lit("CANNOT_LINK").alias("constraint_type"))
    return p.add_constraints(old, new)


C5 = """
, m AS (SELECT cluster_id, CASE WHEN person_id % 3 = 2 THEN person_id - 1 ELSE person_id END AS person_id FROM v_clusters)
SELECT p.person_id, (SELECT count(*) FROM m WHERE m.person_id = p.person_id) AS clusters, (SELECT count(DISTINCT f.photo_id) FROM m JOIN v_faces f ON f.cluster_id = m.cluster_id AND NOT f.deleted WHERE m.person_id = p.person_id) AS photos,
 (SELECT count(*) FROM v_persons s WHERE s.person_id % 3 = 2 AND s.person_id - 1 = p.person_id) AS merged FROM v_persons p WHERE p.person_id % 3 <> 2
"""


@query("c5_merge_persons", "SELECT cluster_id, CASE WHEN person_id % 3 = 2 THEN person_id - 1 ELSE person_id END AS person_id FROM v_clusters")
def merge_persons(v):
    return t.reassign(v.clusters, merges(v), "person_id", live_only=False).select("cluster_id", "person_id")


def merges(v):
    return v.persons.filter("person_id % 3 = 2").select(F.col("person_id").alias("old"), (F.col("person_id") - 1).alias("new"))


@query("c5_merged_persons", C5)
def merged_persons(v):
    """The persons left, recounted, with how many were merged into each (one history row each)."""
    return p.merge_persons(v.persons, v.clusters, t.live(v.faces), merges(v))


C6 = "SELECT c.cluster_id, count(f.face_id) AS face_count FROM v_clusters c JOIN v_faces f ON f.cluster_id = c.cluster_id AND NOT f.deleted AND f.photo_id % 5 <> 0 GROUP BY 1"


@query("c6_remove_photos", C6)
def remove_photos(v):
    return p.remove_photos(v.clusters, t.live(v.faces), removed(v)).select("cluster_id", "face_count")


def removed(v):
    return v.photos.filter("photo_id % 5 = 0").select("photo_id")


C6B = """
, h AS (SELECT cluster_id, count(*) AS n, arg_min(face_id, (-coalesce(quality_score, 0), face_id)) AS best FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL AND photo_id % 5 <> 0 GROUP BY 1),
pp AS (SELECT c.person_id, count(DISTINCT f.photo_id) AS photos FROM v_clusters c JOIN v_faces f ON f.cluster_id = c.cluster_id AND NOT f.deleted AND f.photo_id % 5 <> 0 GROUP BY 1)
SELECT c.cluster_id, coalesce(h.n, 0) AS face_count, h.n IS NULL AS cluster_deleted, h.best AS representative, c.person_id, c.person_id IS NOT NULL AND pp.photos IS NULL AS person_deleted FROM v_clusters c LEFT JOIN h USING (cluster_id) LEFT JOIN pp ON pp.person_id = c.person_id
"""


@query("c6_after_removal", C6B)
def after_removal(v):
    """Every cluster after photos are taken away: count, representative, and what becomes empty and goes."""
    return p.after_removal(v.clusters, t.live(v.faces), removed(v))


@query("c7_record_history", "SELECT history_id, operation_type, ts + INTERVAL 30 DAY AS expires_at FROM v_history")
def record_history(v):
    return p.record_history(v.history).select("history_id", "operation_type", "expires_at")


C8 = "SELECT cluster_id, history_id, operation_type, operation_type IN ('RENAME', 'MOVE_FACE') AS reversible FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, history_id DESC) AS n FROM v_history WHERE can_undo) WHERE n = 1"


@query("c8_undo_last", C8)
def undo_last(v):
    return p.undo_plan(v.history)


C8B = """
, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, history_id DESC) AS n FROM v_history WHERE can_undo) WHERE n = 1),
nm AS (SELECT c.person_id, arg_max(u.history_id, (u.ts, u.history_id)) AS h FROM u JOIN v_clusters c USING (cluster_id) WHERE u.operation_type = 'RENAME' AND c.person_id IS NOT NULL GROUP BY 1),
bf AS (SELECT cluster_id, arg_min(face_id, (-coalesce(quality_score, 0), face_id)) AS face_id FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL GROUP BY 1)
SELECT 'RENAME' AS operation_type, person_id::varchar AS key, concat('Before ', h) AS value FROM nm
UNION ALL SELECT 'MOVE_FACE', bf.face_id, u.cluster_id::varchar FROM u JOIN bf ON bf.cluster_id = u.source_cluster_id WHERE u.operation_type = 'MOVE_FACE'
"""


@query("c8_replay_undo", C8B)
def replay_undo(v):
    """What undoing the newest operation of each cluster sets: names of persons, clusters of faces. Merges stay."""
    history = v.history.withColumn("previous_name", F.concat(F.lit("Before "), F.col("history_id").cast("string")))
    moved = p.best_faces(t.live(v.faces)).select(F.col("cluster_id").alias("source_cluster_id"), F.col("best").alias("face_id"))
    return p.replay_undo(history.join(moved, "source_cluster_id", "left"), v.clusters)


C9 = """
SELECT c.cluster_id, (SELECT max(display_number) FROM v_persons) + row_number() OVER (ORDER BY c.cluster_id) AS display_number, c.photos
FROM (SELECT c.cluster_id, count(DISTINCT f.photo_id) AS photos FROM v_clusters c JOIN v_faces f ON f.cluster_id = c.cluster_id AND NOT f.deleted WHERE c.person_id IS NULL AND NOT c.deleted GROUP BY 1) c
"""


@query("c9_fix_orphans", C9)
def fix_orphans(v):
    return p.fix_orphans(v.clusters, v.faces, v.persons).select("cluster_id", "display_number", "photos")


C9B = """
, lonely AS (SELECT c.cluster_id, count(f.face_id) AS n, count(DISTINCT f.photo_id) AS photos, arg_min(f.face_id, (-coalesce(f.quality_score, 0), f.face_id)) AS best FROM v_clusters c LEFT JOIN v_faces f ON f.cluster_id = c.cluster_id AND NOT f.deleted WHERE c.person_id IS NULL AND NOT c.deleted GROUP BY 1)
SELECT cluster_id, CASE WHEN n = 0 THEN 'DELETED' ELSE 'LINKED' END AS outcome, CASE WHEN n > 0 THEN (SELECT max(display_number) FROM v_persons) + row_number() OVER (PARTITION BY n > 0 ORDER BY cluster_id) END AS display_number, CASE WHEN n > 0 THEN photos END AS photos, best AS representative FROM lonely
"""


@query("c9_orphan_report", C9B)
def orphan_report(v):
    """Each live cluster without a person: linked to a new person with its best face, or deleted as empty."""
    return p.orphan_report(v.clusters, v.faces, v.persons)


C10 = "SELECT person_id, CASE WHEN person_id % 8 = 1 THEN NULL ELSE name END AS name, CASE WHEN person_id % 8 = 1 THEN '02-29' ELSE birthday END AS birthday, CASE WHEN person_id % 8 = 1 THEN NOT is_hidden ELSE is_hidden END AS is_hidden FROM v_persons"


@query("c10_profile_edits", C10)
def profile_edits(v):
    """New name (blank: none), birthday and visibility for some persons."""
    edits = v.persons.filter("person_id % 8 = 1").select("person_id", F.nullif(F.trim(F.lit("   ")), F.lit("")).alias("name"), F.lit("02-29").alias("birthday"), (~F.col("is_hidden")).alias("is_hidden"))
    return t.update_from(v.persons.select("person_id", "name", "birthday", "is_hidden"), edits, "person_id", ["name", "birthday", "is_hidden"])


@query("c11_birthdays", "SELECT person_id, birthday FROM v_persons WHERE NOT deleted AND (birthday >= '12-28' OR birthday <= '01-26')")
def birthdays(v):
    return p.birthdays(t.live(v.persons), "2023-12-28", 30).select("person_id", "birthday")


@query("t6_retry_plan", "SELECT cluster_id, count(*) AS attempts, CASE WHEN count(*) < 2 THEN 'PENDING' ELSE 'FAILED' END AS status, 0.5 * power(2, least(count(*) - 1, 5)) AS backoff_s FROM v_history WHERE operation_type = 'DELETE' GROUP BY 1")
def retry_plan(v):
    return p.retry_plan(v.history.filter("operation_type = 'DELETE'"), "cluster_id")
