"""People, their photos and faces: joins, counts, best-of-group picks, constraints and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.operators.tables import live, running_total


def person_faces(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Live faces of live clusters with the cluster's person (null: none)."""
    return live(faces).join(live(clusters).select("cluster_id", "person_id"), "cluster_id")


def photos_of_person(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    own = person_faces(faces, clusters).filter("person_id IS NOT NULL")
    return own.groupBy("person_id", "photo_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("best_match"), F.max("confidence").alias("best_confidence"))


def solo_photos(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Photos on which one person appears alone; faces of nobody don't count."""
    shown = person_faces(faces, clusters).filter("person_id IS NOT NULL")
    both = shown.groupBy("photo_id").agg(F.min("person_id").alias("person_id"), F.max("person_id").alias("other"))
    return both.filter("person_id = other").select("person_id", "photo_id")


def photos_with_all(faces: DataFrame, clusters: DataFrame, persons: list[int]) -> DataFrame:
    """Photos that show every person of a set; an empty set finds none."""
    wanted = sorted(set(persons))
    shown = person_faces(faces, clusters).filter(F.col("person_id").isin(wanted) if wanted else F.lit(False))
    return shown.groupBy("photo_id").agg(F.count_distinct("person_id").alias("n")).filter(F.col("n") == len(wanted)).select("photo_id")


def persons_with_face(persons: DataFrame, clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """Visible persons with their best face; persons without an eligible face drop out."""
    area = (F.col("bbox_right") - F.col("bbox_left")) * (F.col("bbox_bottom") - F.col("bbox_top"))
    eligible = person_faces(faces.filter(F.col("quality_tier").isin("ANCHOR", "CLUSTERING")), clusters)
    order = [F.col("quality_score").desc(), F.coalesce("match_score", F.lit(0.0)).desc(), area.desc(), F.col("face_id")]
    top = best_per_group(eligible.filter("person_id IS NOT NULL"), ["person_id"], order).select("person_id", "face_id", "photo_id")
    shown = live(persons).filter("NOT is_hidden").select("person_id", "name", "photo_count")
    return shown.join(top, "person_id").orderBy(F.col("photo_count").desc(), "person_id")


def best_face(faces: DataFrame, rule: str) -> DataFrame:
    """person_id and face_id by the detail view's rule (match) or the thumbnail's."""
    match = F.coalesce("match_score", F.lit(0.0)).desc()
    orders = {
        "match": [match, F.col("confidence").desc()],
        "thumbnail": [(F.col("eye_visibility_score") > 0).desc(), F.col("quality_score").desc(), match],
    }
    own = faces.filter("person_id IS NOT NULL")
    return best_per_group(own, ["person_id"], [*orders[rule], F.col("face_id")]).select("person_id", "face_id")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def best_per_pose(anchors: DataFrame) -> DataFrame:
    """The best anchors of each cluster and pose, ties kept."""
    ranked = anchors.withColumn("_rank", F.rank().over(W.partitionBy("cluster_id", "pose_category").orderBy(F.col("quality_score").desc())))
    priority = F.when(F.col("pose_category") == "FRONTAL", 0).when(F.col("pose_category").startswith("SLIGHT"), 1).otherwise(2)
    return ranked.filter("_rank = 1").drop("_rank").orderBy("cluster_id", priority, "anchor_id")


def compact_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def diff_keys(base: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Keys that the derived table misses, and orphans that the base lacks."""
    a, b = base.withColumn("_base", F.lit(True)), derived.withColumn("_derived", F.lit(True))
    both = a.join(b, key, "full_outer").filter("_base IS NULL OR _derived IS NULL")
    return both.select(key, F.when(F.col("_base").isNull(), "orphaned").otherwise("missing").alias("side"))


def pairs_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs a, b of rows of a group with a's key smaller; groups are photos or anchor sets, small by nature."""
    a, b = df.alias("a"), df.alias("b")
    joined = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    sides = [F.struct(*[F.col(f"{side}.{c}") for c in df.columns]).alias(side) for side in "ab"]
    return joined.select(F.col(f"a.{group}").alias(group), *sides)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(column).alias(name))


def table_counts(faces: DataFrame, persons: DataFrame, photos: DataFrame) -> DataFrame:
    """One row of counts; each table is read once."""
    parts = [
        live(faces).agg(F.count("*").alias("faces"), F.count("cluster_id").alias("clustered")),
        live(persons).agg(F.count_if(~F.col("is_hidden")).alias("visible_persons")),
        photos.agg(F.count_if(F.col("scan_status") == "PENDING").alias("pending")),
    ]
    keyed = [x.withColumn("_one", F.lit(1)) for x in parts]
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")


def recount_photos(persons: DataFrame, faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Photo counts from the faces; deleted persons keep their old count."""
    counted = distinct_counts(person_faces(faces, clusters).filter("person_id IS NOT NULL"), "person_id", "photo_id", "_n")
    joined = persons.join(counted, "person_id", "left")
    return joined.withColumn("photo_count", F.when(F.col("deleted"), F.col("photo_count")).otherwise(F.coalesce("_n", F.lit(0)))).drop("_n")


def assign_display_numbers(persons: DataFrame) -> DataFrame:
    """Numbers for persons without one, after the largest, in order of person_id."""
    largest = persons.agg(F.coalesce(F.max("display_number"), F.lit(0))).first()[0]
    new = running_total(persons.filter("display_number IS NULL"), "person_id", F.lit(1), "_place")
    return persons.filter("display_number IS NOT NULL").unionByName(new.select("person_id", (F.col("_place") + largest).alias("display_number")))


def pose_distribution(anchors: DataFrame) -> DataFrame:
    counted = anchors.groupBy("cluster_id", "pose_category").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("pose_category", "n")))
    return counted.groupBy("cluster_id").agg(F.to_json(F.map_from_entries(pairs)).alias("poses"))


def embedding_source_stats(faces: DataFrame) -> DataFrame:
    """Counts, whole percentages, faces whose alignment succeeded or failed, and low-quality ones by embedding source."""
    counted = faces.groupBy("embedding_source").agg(F.count("*").alias("n"), F.count_if("aligned").alias("aligned"), F.count_if(~F.col("aligned")).alias("not_aligned"), F.count_if(F.col("alignment_quality") < 0.3).alias("low"))
    # A handful of sources: the total is a window over them.
    return counted.withColumn("percent", F.floor(F.col("n") * 100 / F.sum("n").over(W.partitionBy(F.lit(1)))))


def backfill_display_number(persons: DataFrame) -> DataFrame:
    """How many persons were created up to each one; ties share."""
    by_time = persons.groupBy("created_at").agg(F.count("*").alias("_n"))
    numbered = running_total(by_time, "created_at", F.col("_n"), "display_number").select("created_at", "display_number")
    return persons.join(numbered, "created_at").select("person_id", "display_number")


def scan_rate(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """df with the mean of the last n values, and how many rows of the key are still to come."""
    own = W.partitionBy(key).orderBy(*order)
    waiting = F.count("*").over(W.partitionBy(key)) - F.row_number().over(own)
    return df.withColumn("rate", F.avg(value).over(own.rowsBetween(1 - n, 0))).withColumn("waiting", waiting)


def stable_order(current: DataFrame, known: DataFrame) -> DataFrame:
    """Place in a list: persons shown before come first, each part by photo count."""
    before = known.select("person_id").distinct().withColumn("_known", F.lit(True))
    marked = current.join(before, "person_id", "left").withColumn("_new", F.col("_known").isNull().cast("long"))
    ordered = running_total(marked.withColumn("_less", -F.col("photo_count")), ["_new", "_less", "person_id"], F.lit(1), "place")
    return ordered.select("person_id", "place")


def same_photo_constraints(faces: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Pairs of faces on one photo, smaller id first, without the existing ones."""
    pairs = pairs_within(faces, "photo_id", "face_id").select(F.col("a.face_id").alias("face_id1"), F.col("b.face_id").alias("face_id2"))
    if existing is None:
        return pairs
    canonical = existing.select(F.least("face_id1", "face_id2").alias("face_id1"), F.greatest("face_id1", "face_id2").alias("face_id2"))
    return pairs.join(canonical, ["face_id1", "face_id2"], "left_anti")


def violations(assigned: DataFrame, constraints: DataFrame) -> DataFrame:
    """Faces whose cluster holds a face that they must not share it with; constraints hold a pair once."""
    one = constraints.select(F.col("face_id1").alias("face_id"), F.col("face_id2").alias("partner"))
    both = one.unionByName(constraints.select(F.col("face_id2").alias("face_id"), F.col("face_id1").alias("partner")))
    other = assigned.select(F.col("face_id").alias("partner"), F.col("cluster_id").alias("_cluster"))
    return both.join(assigned.select("face_id", "cluster_id"), "face_id").join(other, "partner").filter("cluster_id = _cluster").select("face_id", "cluster_id", "partner")


def add_constraints(constraints: DataFrame, new: DataFrame) -> DataFrame:
    """Append pairs, smaller id first, once each."""
    ordered = new.select(F.least("face_id1", "face_id2").alias("face_id1"), F.greatest("face_id1", "face_id2").alias("face_id2"), "constraint_type").distinct()
    fresh = ordered.join(constraints, ordered.columns, "left_anti")
    return constraints.unionByName(fresh)


def remove_photos(clusters: DataFrame, faces: DataFrame, removed: DataFrame) -> DataFrame:
    """Recounted clusters after photos are taken away; empty clusters go."""
    left = faces.join(removed, "photo_id", "left_anti").filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("_n"))
    return clusters.join(left, "cluster_id").withColumn("face_count", F.col("_n")).drop("_n")


def best_faces(faces: DataFrame) -> DataFrame:
    """cluster_id, n, photos and the best face (quality, then id) of the clusters of live faces."""
    order = F.struct(-F.coalesce("quality_score", F.lit(0)), F.col("face_id"))
    own = faces.filter("cluster_id IS NOT NULL").groupBy("cluster_id")
    return own.agg(F.count("*").alias("n"), F.count_distinct("photo_id").alias("photos"), F.min_by("face_id", order).alias("best"))


def after_removal(clusters: DataFrame, faces: DataFrame, removed: DataFrame) -> DataFrame:
    """All clusters after photos are taken away: recounted, best face picked again, empty clusters and persons marked."""
    left = faces.join(removed, "photo_id", "left_anti")
    placed = clusters.select("cluster_id", "person_id").join(best_faces(left), "cluster_id", "left")
    alive = placed.filter("n IS NOT NULL AND person_id IS NOT NULL").select("person_id").distinct().withColumn("_alive", F.lit(True))
    both = placed.join(alive, "person_id", "left")
    return both.select("cluster_id", F.coalesce("n", F.lit(0)).alias("face_count"), F.col("n").isNull().alias("cluster_deleted"), F.col("best").alias("representative"), "person_id", (F.col("person_id").isNotNull() & F.col("_alive").isNull()).alias("person_deleted"))


def merge_persons(persons: DataFrame, clusters: DataFrame, faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """person_id, clusters, photos, merged of the persons that stay after (old, new) merges."""
    to = clusters.select("cluster_id", "person_id").join(mapping.select(F.col("old").alias("person_id"), "new"), "person_id", "left")
    moved = to.select("cluster_id", F.coalesce("new", "person_id").alias("person_id"))
    owned = moved.groupBy("person_id").agg(F.count("*").alias("clusters"))
    seen = moved.join(faces.select("cluster_id", "photo_id"), "cluster_id").groupBy("person_id").agg(F.count_distinct("photo_id").alias("photos"))
    sources = mapping.groupBy(F.col("new").alias("person_id")).agg(F.count("*").alias("merged"))
    left = persons.select("person_id").join(mapping.select(F.col("old").alias("person_id")), "person_id", "left_anti")
    for more in (owned, seen, sources):
        left = left.join(more, "person_id", "left")
    return left.na.fill(0, ["clusters", "photos", "merged"])


def orphan_report(clusters: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """cluster_id, outcome, display_number, photos, representative of every live cluster without a person."""
    lonely = live(clusters).filter("person_id IS NULL").select("cluster_id")
    linked = fix_orphans(clusters, faces, persons).select("cluster_id", "display_number")
    found = best_faces(live(faces)).select("cluster_id", "photos", "best")
    both = lonely.join(found, "cluster_id", "left").join(linked, "cluster_id", "left")
    return both.select("cluster_id", F.when(F.col("best").isNull(), "DELETED").otherwise("LINKED").alias("outcome"), "display_number", "photos", F.col("best").alias("representative"))


def record_history(events: DataFrame, days: int = 30) -> DataFrame:
    return events.withColumn("expires_at", F.col("ts") + F.expr(f"INTERVAL {days} DAYS"))


def undo_plan(history: DataFrame) -> DataFrame:
    """The newest operation of each cluster that may be undone, and whether it can be replayed."""
    last = best_per_group(history.filter("can_undo"), ["cluster_id"], [F.col("ts").desc(), F.col("history_id").desc()])
    return last.select("cluster_id", "history_id", "operation_type", F.col("operation_type").isin("RENAME", "MOVE_FACE").alias("reversible"))


def replay_undo(history: DataFrame, clusters: DataFrame) -> DataFrame:
    """operation_type, key, value: the name each person and the cluster each face gets back by undoing the newest operations.

    history has face_id and previous_name beside its own columns. Of several renames of one person the newest counts.
    """
    last = best_per_group(history.filter("can_undo"), ["cluster_id"], [F.col("ts").desc(), F.col("history_id").desc()])
    named = last.filter("operation_type = 'RENAME'").join(clusters.filter("person_id IS NOT NULL").select("cluster_id", "person_id"), "cluster_id")
    newest = named.groupBy("person_id").agg(F.max_by("previous_name", F.struct("ts", "history_id")).alias("value"))
    moved = last.filter("operation_type = 'MOVE_FACE' AND face_id IS NOT NULL").select(F.lit("MOVE_FACE").alias("operation_type"), F.col("face_id").alias("key"), F.col("cluster_id").cast("string").alias("value"))
    return newest.select(F.lit("RENAME").alias("operation_type"), F.col("person_id").cast("string").alias("key"), "value").unionByName(moved)


def fix_orphans(clusters: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """A person for each live cluster that has faces but no person."""
    lonely = live(clusters).filter("person_id IS NULL").select("cluster_id")
    counted = live(faces).join(lonely, "cluster_id").groupBy("cluster_id").agg(F.count_distinct("photo_id").alias("photos"))
    largest = persons.agg(F.coalesce(F.max("display_number"), F.lit(0))).first()[0]
    numbered = running_total(counted, "cluster_id", F.lit(1), "_place")
    person = F.sha2(F.concat(F.lit("person-"), F.col("cluster_id").cast("string")), 256)
    return numbered.select("cluster_id", (F.col("_place") + largest).alias("display_number"), "photos", person.alias("new_person_id"))


def birthdays(persons: DataFrame, day: str, n: int) -> DataFrame:
    """Persons whose birthday falls on day or the n - 1 days after it."""
    days = F.transform(F.sequence(F.lit(day).cast("date"), F.date_add(F.lit(day).cast("date"), n - 1)), lambda d: F.date_format(d, "MM-dd"))
    return persons.filter(F.array_contains(days, F.col("birthday")))


def retry_plan(failures: DataFrame, key: str, most: int = 2) -> DataFrame:
    """Attempts so far, whether to try again, and the wait before it."""
    counted = failures.groupBy(key).agg(F.count("*").alias("attempts"))
    wait = F.lit(0.5) * F.pow(F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(5)))
    return counted.withColumn("status", F.when(F.col("attempts") < most, "PENDING").otherwise("FAILED")).withColumn("backoff_s", wait)
