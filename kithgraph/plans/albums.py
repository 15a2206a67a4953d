"""Presets for albums, descriptors of pictures, and snapshots of tables."""

from pyspark.sql import functions as F

from kithgraph.functions import scoring as s
from kithgraph.operators import imaging, tables
from kithgraph.plans.catalog import query
from kithgraph.sources.storage import new_folder

#: name, kind, longest seconds of a film (templates: none), seconds an image (templates) or recommended (platforms)
PRESETS = (("quick", "TEMPLATE", None, 1.5), ("calm", "TEMPLATE", None, 4.0), ("short", "PLATFORM", 60, 2.0), ("reel", "PLATFORM", 90, 2.5), ("long", "PLATFORM", 600, 3.0))

M11 = """
, a AS (SELECT album_id, count(*) AS n FROM v_images GROUP BY 1),
p(preset, kind, longest, seconds) AS (VALUES ('quick', 'TEMPLATE', NULL, 1.5), ('calm', 'TEMPLATE', NULL, 4.0), ('short', 'PLATFORM', 60, 2.0), ('reel', 'PLATFORM', 90, 2.5), ('long', 'PLATFORM', 600, 3.0)),
d AS (SELECT album_id, n, preset, longest, CASE WHEN kind = 'TEMPLATE' THEN least(seconds::double, greatest(1, least(5, 60::double / n))) ELSE greatest(1, least(5, longest::double / n)) END AS each FROM a, p)
SELECT album_id, preset, round(each, 6) AS seconds, round(each * n, 6) AS total, longest IS NULL OR round(each * n, 6) <= longest AS fits FROM d
"""


@query("m11_apply_preset", M11)
def apply_preset(v):
    """Seconds an image for every album under every preset, and whether the film keeps the platform's limit."""
    presets = v.spark.createDataFrame(PRESETS, "preset string, kind string, longest int, seconds double")
    # Five rows.
    both = v.images.groupBy("album_id").agg(F.count("*").alias("n")).join(F.broadcast(presets), F.lit(True))
    each = F.when(F.col("kind") == "TEMPLATE", F.least("seconds", s.clamp(60.0 / F.col("n"), 1, 5))).otherwise(s.clamp(F.col("longest") / F.col("n"), 1, 5))
    total = F.round(each * F.col("n"), 6)
    return both.select("album_id", "preset", F.round(each, 6).alias("seconds"), total.alias("total"), (F.col("longest").isNull() | (total <= F.col("longest"))).alias("fits"))


@query("q2_hash_descriptor")
def hash_descriptor(v):
    """Descriptors of 8 x 8 pictures made from the embeddings' values, one colour a third of the way apart."""
    pixels = F.transform(imaging.levels("embedding"), lambda g: F.shiftleft(g, 16).bitwiseOR(F.shiftleft((g * 2) % 256, 8)).bitwiseOR((g * 3) % 256))
    pictures = v.table("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), pixels.alias("pixels"))
    return imaging.hash_descriptors(pictures)


@query("s10_snapshot", "SELECT 'clusters' AS name, cluster_id AS key, face_count AS value FROM v_clusters UNION ALL SELECT 'persons', person_id, photo_count FROM v_persons")
def snapshot(v):
    """Two tables written as one version and read back."""
    path = new_folder(v.spark, "snapshot")
    tables.write_snapshot({"clusters": v.clusters, "persons": v.persons}, path, 1, {"clusters": "cluster_id", "persons": "person_id"})
    found = tables.read_snapshot(v.spark, path)
    one = found["clusters"].select(F.lit("clusters").alias("name"), F.col("cluster_id").alias("key"), F.col("face_count").alias("value"))
    return one.unionByName(found["persons"].select(F.lit("persons").alias("name"), F.col("person_id").alias("key"), F.col("photo_count").alias("value")))
