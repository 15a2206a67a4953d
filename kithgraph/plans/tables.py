"""Queries over single tables: writing, filtering, paging."""

from pyspark.sql import functions as F

from kithgraph.operators import tables as t
from kithgraph.plans.catalog import query

FACES = ["face_id", "photo_id", "cluster_id", "quality_score", "match_score"]
FACE_COLUMNS = ", ".join(FACES)


@query("s1_ingest_catalog", "SELECT photo_id, date_trunc('second', date_added) AS date_added, 'PENDING' AS scan_status FROM v_photos WHERE size_bytes > 0")
def ingest(v):
    listing = v.photos.select("photo_id", "size_bytes", F.unix_timestamp(F.col("date_added").cast("timestamp")).alias("seconds"))
    return t.ingest_catalog(listing).withColumn("date_added", F.col("date_added").cast("timestamp_ntz"))


@query("s2_insert_ignore", "SELECT photo_id, scan_status FROM v_photos WHERE photo_id % 2 = 0 UNION ALL SELECT photo_id, 'NEW' FROM v_photos WHERE photo_id % 2 = 1")
def insert_ignore(v):
    old = v.photos.filter("photo_id % 2 = 0").select("photo_id", "scan_status")
    return t.insert_ignore(old, v.photos.select("photo_id", F.lit("NEW").alias("scan_status")), "photo_id")


UPSERT = """
SELECT person_id, name, updated FROM v_new WHERE n = 1
UNION ALL SELECT person_id, name, created_at FROM v_persons WHERE person_id NOT IN (SELECT person_id FROM v_new)
"""


@query("s3_upsert", ", v_new AS (SELECT photo_id % 50 AS person_id, bucket_name AS name, photo_id AS updated, row_number() OVER (PARTITION BY photo_id % 50 ORDER BY photo_id DESC) AS n FROM v_photos)" + UPSERT)
def upsert(v):
    old = v.persons.select("person_id", "name", F.col("created_at").alias("updated"))
    new = v.photos.select((F.col("photo_id") % 50).alias("person_id"), F.col("bucket_name").alias("name"), F.col("photo_id").alias("updated"))
    return t.upsert(old, new, "person_id", "updated")


@query("s4_update_columns", "SELECT person_id, CASE WHEN person_id % 6 = 0 THEN NULL WHEN person_id % 3 = 0 THEN 'named' ELSE name END AS name, photo_count FROM v_persons")
def update_columns(v):
    changes = v.persons.filter("person_id % 3 = 0").select("person_id", F.expr("CASE WHEN person_id % 6 <> 0 THEN 'named' END").alias("name"))
    return t.update_from(v.persons.select("person_id", "name", "photo_count"), changes, "person_id", ["name"])


@query("s5_reassign", "SELECT face_id, CASE WHEN NOT deleted AND cluster_id % 3 = 1 THEN cluster_id - 1 ELSE cluster_id END AS cluster_id FROM v_faces")
def reassign(v):
    mapping = v.clusters.filter("cluster_id % 3 = 1").select(F.col("cluster_id").alias("old"), (F.col("cluster_id") - 1).alias("new"))
    return t.reassign(v.faces.select("face_id", "cluster_id", "deleted"), mapping, "cluster_id").select("face_id", "cluster_id")


@query("s6_delete_photos", "SELECT face_id FROM v_faces WHERE photo_id NOT IN (SELECT photo_id FROM v_photos WHERE scan_status = 'PENDING')")
def delete_photos(v):
    return t.delete_cascade({"photos": v.photos, "faces": v.faces}, "photos", F.col("scan_status") == "PENDING")["faces"].select("face_id")


@query("s6_delete_persons", "SELECT cluster_id, CASE WHEN person_id IN (SELECT person_id FROM v_persons WHERE is_hidden) THEN NULL ELSE person_id END AS person_id FROM v_clusters")
def delete_persons(v):
    tables = {"persons": v.persons, "clusters": v.clusters.select("cluster_id", "person_id")}
    return t.delete_cascade(tables, "persons", F.col("is_hidden"))["clusters"]


@query("s7_soft_delete", "SELECT person_id, deleted OR person_id % 4 = 1 AS deleted FROM v_persons")
def soft_delete(v):
    return t.soft_delete(v.persons.select("person_id", "deleted"), v.persons.filter("person_id % 4 = 1"), "person_id")


@query("s7_restore", "SELECT person_id, deleted AND person_id % 2 = 1 AS deleted FROM v_persons")
def restore(v):
    return t.restore(v.persons.select("person_id", "deleted"), v.persons.filter("person_id % 2 = 0"), "person_id")


@query("s8_purge_deleted", "SELECT face_id FROM v_faces WHERE NOT (deleted AND deleted_at < TIMESTAMP '2000-01-01 00:00:00')")
def purge_deleted(v):
    return t.purge(v.faces, F.col("deleted") & (F.col("deleted_at") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))).select("face_id")


@query("s8_purge_history", "SELECT history_id FROM v_history WHERE NOT (expires AND ts + INTERVAL 30 DAY < TIMESTAMP '2024-02-10 00:00:00')")
def purge_history(v):
    spent = F.col("expires") & (F.col("ts") + F.expr("INTERVAL 30 DAYS") < F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))
    return t.purge(v.history, spent).select("history_id")


@query("s8_purge_staged", "SELECT face_id, status FROM v_staged WHERE NOT (status IN ('COMMITTED', 'REJECTED') OR created_at < TIMESTAMP '1998-06-01 00:00:00')")
def purge_staged(v):
    old = F.col("created_at") < F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return t.purge(v.staged, F.col("status").isin("COMMITTED", "REJECTED") | old).select("face_id", "status")


@query("s9_increments", "SELECT person_id, photo_count + (SELECT count(*) FROM v_clusters c WHERE c.person_id = p.person_id) AS photo_count FROM v_persons p")
def increments(v):
    return t.apply_increments(v.persons.select("person_id", "photo_count"), v.clusters.filter("person_id IS NOT NULL"), "person_id", "photo_count")


@query("f1_live_lookup", f"SELECT {FACE_COLUMNS} FROM v_faces WHERE NOT deleted AND photo_id IN (SELECT photo_id FROM v_photos WHERE album_id = 7)")
def live_lookup(v):
    return t.lookup(v.faces, "photo_id", v.photos.filter("album_id = 7")).select(*FACES)


@query("f1_lookup_deleted_too", f"SELECT {FACE_COLUMNS} FROM v_faces WHERE photo_id IN (SELECT photo_id FROM v_photos WHERE album_id = 7)")
def lookup_all(v):
    return t.lookup(v.faces, "photo_id", v.photos.filter("album_id = 7"), include_deleted=True).select(*FACES)


@query("f2_threshold_lookup", "SELECT cluster_id, acceptance_threshold FROM v_statistics WHERE cluster_id IN (1, 5, 9, 14, 200)")
def threshold_lookup(v):
    return v.statistics.filter(F.col("cluster_id").isin(1, 5, 9, 14, 200)).select("cluster_id", "acceptance_threshold")


@query("f3_unclustered_faces", "SELECT face_id, quality_score FROM v_faces WHERE NOT deleted AND cluster_id IS NULL AND match_score IS NOT NULL")
def unclustered(v):
    return t.unassigned(v.faces, "cluster_id", "match_score").select("face_id", "quality_score").orderBy(F.col("quality_score").desc(), "face_id")


@query("f3_unassigned_clusters", "SELECT cluster_id, face_count FROM v_clusters WHERE NOT deleted AND person_id IS NULL")
def unassigned_clusters(v):
    return t.unassigned(v.clusters, "person_id").select("cluster_id", "face_count").orderBy(F.col("face_count").desc(), "cluster_id")


@query("f4_visible_persons", "SELECT person_id, name, photo_count FROM v_persons WHERE NOT deleted AND NOT is_hidden")
def visible(v):
    return t.live(v.persons).filter("NOT is_hidden").select("person_id", "name", "photo_count").orderBy(F.col("photo_count").desc(), "person_id")


@query("f5_pending_photos", "SELECT photo_id, date_added FROM v_photos WHERE scan_status = 'PENDING' ORDER BY date_added DESC, photo_id LIMIT 100")
def pending(v):
    return t.by_status(v.photos, "PENDING", [F.col("date_added").desc(), F.col("photo_id")], 100).select("photo_id", "date_added")


@query("f5_verified_faces", "SELECT face_id, quality_score FROM v_staged WHERE status = 'VERIFIED'")
def verified(v):
    return t.by_status(v.staged, "VERIFIED", [F.col("quality_score").desc(), F.col("face_id")]).select("face_id", "quality_score")


@query("f5_pending_older", "SELECT face_id FROM v_staged WHERE status = 'PENDING' AND created_at < TIMESTAMP '2000-01-01 00:00:00'")
def pending_older(v):
    old = F.col("created_at") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return t.by_status(v.staged, "PENDING", [F.col("created_at"), F.col("face_id")]).filter(old).select("face_id")


@query("f6_face_count_range", "SELECT cluster_id, face_count FROM v_clusters WHERE NOT deleted AND face_count BETWEEN 10 AND 20")
def face_count_range(v):
    return t.range_filter(t.live(v.clusters), "face_count", 10, 20).select("cluster_id", "face_count")


@query("f6_threshold_below", "SELECT cluster_id, acceptance_threshold FROM v_statistics WHERE acceptance_threshold < 0.3")
def threshold_below(v):
    return v.statistics.filter("acceptance_threshold < 0.3D").select("cluster_id", "acceptance_threshold")


@query("f6_high_variance", "SELECT cluster_id FROM v_statistics WHERE variance_similarity > 0.25 OR min_similarity < 0.1 OR last_updated < 30")
def high_variance(v):
    return v.statistics.filter("variance_similarity > 0.25 OR min_similarity < 0.1 OR last_updated < 30").select("cluster_id")


@query("f7_conflicting", "SELECT face_id FROM v_staged WHERE status = 'PENDING' AND conflicting_cluster_id IS NOT NULL AND candidate_similarity - conflicting_similarity < 0.15")
def conflicting(v):
    return t.conflicting(v.staged).select("face_id")


@query("f8_active_anchors", "SELECT anchor_id, cluster_id, quality_score FROM v_anchors WHERE is_active AND pose_category = 'FRONTAL'")
def active_anchors(v):
    return t.anchors(v.anchors, True, "FRONTAL").select("anchor_id", "cluster_id", "quality_score")


@query("f9_cluster_photos", "SELECT DISTINCT cluster_id, photo_id FROM v_faces WHERE NOT deleted AND cluster_id IS NOT NULL")
def cluster_photos(v):
    return t.distinct_values(t.live(v.faces).filter("cluster_id IS NOT NULL"), "cluster_id", "photo_id")


@query("f9_cluster_poses", "SELECT DISTINCT cluster_id, pose_category FROM v_anchors WHERE is_active")
def cluster_poses(v):
    return t.distinct_values(t.anchors(v.anchors), "cluster_id", "pose_category")


@query("f10_exists_many", "SELECT cluster_id, person_id, EXISTS (SELECT 1 FROM v_anchors a WHERE a.is_active AND a.cluster_id = c.cluster_id AND a.pose_category = 'FRONTAL') AS found FROM v_clusters c")
def exists_many(v):
    return t.exists_many(t.anchors(v.anchors, True, "FRONTAL"), v.clusters.select("cluster_id", "person_id"), ["cluster_id"])


PARTNERS = """
SELECT face_id1 AS face_id, face_id2 AS partner, constraint_type FROM v_constraints WHERE constraint_type = 'CANNOT_LINK'
UNION ALL SELECT face_id2, face_id1, constraint_type FROM v_constraints WHERE constraint_type = 'CANNOT_LINK'
"""


@query("f11_partners", PARTNERS)
def partners(v):
    return t.partners(v.constraints, "CANNOT_LINK")


@query("f12_history_of_cluster", "SELECT history_id, operation_type, ts FROM v_history WHERE cluster_id = 12 OR source_cluster_id = 12")
def history_of(v):
    return t.history_of(v.history, 12).select("history_id", "operation_type", "ts")


@query("f12_undoable", "SELECT history_id FROM v_history WHERE can_undo AND (NOT expires OR ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-05 00:00:00') ORDER BY ts DESC, history_id DESC LIMIT 50")
def undoable(v):
    return t.undoable(v.history, "2024-02-05 00:00:00", 50).select("history_id")


@query("f12_merge_history", "SELECT history_id, ts FROM v_history WHERE operation_type = 'MERGE'")
def merge_history(v):
    return v.history.filter("operation_type = 'MERGE'").select("history_id", "ts")


@query("f13_search_persons", "SELECT person_id, name FROM v_persons WHERE lower(name) LIKE '%0001%'")
def search_persons(v):
    return t.search_persons(v.persons, " 0001 ").select("person_id", "name")


@query("f14_search_tracks", "SELECT p_partkey AS track_id, p_name AS title FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%' OR lower(p_brand) LIKE '%red%'", raw=True)
def search_tracks(v):
    return t.search_any(v.table("part"), "Red", ["p_name", "p_type", "p_brand"]).select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"))


@query("f15_display_name", "SELECT person_id, coalesce(name, 'Person ' || coalesce(cast(display_number AS varchar), '?')) AS shown FROM v_persons")
def display_name(v):
    return v.persons.select("person_id", t.display_name().alias("shown"))


@query("l1_page", "SELECT face_id, quality_score FROM v_faces WHERE NOT deleted ORDER BY quality_score DESC, face_id LIMIT 50 OFFSET 100")
def page(v):
    return t.page(t.live(v.faces), [F.col("quality_score").desc(), F.col("face_id")], 50, 100).select("face_id", "quality_score")


@query("l1_page_after_key", "SELECT cluster_id, face_count FROM v_clusters WHERE cluster_id > 120 ORDER BY cluster_id LIMIT 40")
def page_after(v):
    return t.page_after(v.clusters, "cluster_id", 120, 40).select("cluster_id", "face_count")


@query("l2_recently_updated", "SELECT cluster_id, updated_at FROM v_clusters WHERE NOT deleted ORDER BY updated_at DESC, cluster_id LIMIT 20")
def recent(v):
    return t.top_k(t.live(v.clusters), [F.col("updated_at").desc(), F.col("cluster_id")], 20).select("cluster_id", "updated_at")


@query("l3_deleted_faces", "SELECT face_id, deleted_at FROM v_faces WHERE deleted")
def deleted(v):
    return v.faces.filter("deleted").select("face_id", "deleted_at").orderBy(F.col("deleted_at").desc(), "face_id")


@query("l5_order_by_date", "SELECT photo_id, date_taken, row_number() OVER (PARTITION BY album_id ORDER BY date_taken ASC NULLS LAST, photo_id) AS pos FROM v_photos")
def by_date(v):
    from pyspark.sql import Window as W

    place = W.partitionBy("album_id").orderBy(F.col("date_taken").asc_nulls_last(), "photo_id")
    return v.photos.select("photo_id", "date_taken", F.row_number().over(place).alias("pos"))


@query("x1_union_faces", "SELECT face_id, 'clustered' AS origin FROM v_faces WHERE cluster_id IS NOT NULL UNION ALL SELECT face_id, 'free' FROM v_faces WHERE cluster_id IS NULL")
def union_faces(v):
    own = v.faces.filter("cluster_id IS NOT NULL").select("face_id", F.lit("clustered").alias("origin"))
    return own.unionByName(v.faces.filter("cluster_id IS NULL").select("face_id", F.lit("free").alias("origin")))


@query("x2_chunks", "SELECT photo_id, (row_number() OVER (ORDER BY photo_id) - 1) // 40 AS chunk FROM v_photos")
def chunks(v):
    return t.chunks(v.photos.select("photo_id"), "photo_id", 40)
