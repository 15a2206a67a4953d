"""Views that follow change logs: a batch reads and rewrites the buckets that its changes touch, nothing else.

A kept table holds the newest row of each item, dealt by group into ``BUCKETS`` buckets. Batch n writes the buckets it touched
into a folder of its own number, and a list of which batch each bucket is from. It reads the list and the buckets of
batch n - 1, so a batch that runs again reads what it read before, and a new driver goes on from the folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.sources.storage import new_folder
from kithgraph.streaming.jobs import drain

BUCKETS = 64


class Kept:
    """The newest row of each item of a group; ``gone`` rows leave. Changes have the table's columns, ``at`` and ``gone``.

    Rows are dealt once, by bucket, and say which batch touched their item last, so a batch finds what it touched without a join.
    """

    def __init__(self, spark: SparkSession, folder: str, group: str, item: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.group, self.item, self.buckets = spark, folder, group, item, buckets
        self.schema = f"{schema}, at long, gone boolean"
        self.read_rows, self.keys = 0, list(dict.fromkeys((group, item)))

    def versions(self, number: int) -> dict[int, int]:
        """The batch that each bucket is from, up to and with a batch; BUCKETS rows at most."""
        if number < 0:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/list/{number:08d}").collect()
        return {r.bucket: r.version for r in rows}

    def rows(self, number: int, buckets: set[int] | None = None) -> DataFrame:
        return self.marked(number, buckets).drop("touched")

    def marked(self, number: int, buckets: set[int] | None = None) -> DataFrame:
        """Rows with the number of the batch that touched their item last."""
        schema = f"{self.schema}, touched int"
        own = {b: v for b, v in self.versions(number).items() if buckets is None or b in buckets}
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/rows/{v:08d}/bucket={b}" for b, v in own.items()))

    def changes(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/changes/{number:08d}")

    def apply(self, changes: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """Rows of the touched items before and after a batch."""
        bucket = F.pmod(F.xxhash64(self.group), F.lit(self.buckets)).cast("int")
        fields = self.spark.createDataFrame([], self.schema).schema
        names = fields.names
        changes.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.mode("overwrite").parquet(f"{self.folder}/changes/{number:08d}")
        changes = self.changes(number)
        touched = {r.bucket for r in changes.select(bucket.alias("bucket")).distinct().collect()}
        held = self.marked(number - 1, touched)
        self.read_rows = held.count()
        if not self.read_rows:
            held = held.limit(0)
        items = W.partitionBy("bucket", *self.keys)
        order = items.orderBy(F.col("at").desc(), F.col("gone"), *(F.col(c) for c in names if c not in ("at", "gone", self.group, self.item)))
        both = held.unionByName(changes.withColumn("touched", F.lit(number))).withColumn("bucket", bucket).repartition("bucket")
        newest = both.withColumn("_n", F.row_number().over(order)).withColumn("touched", F.max("touched").over(items)).filter("_n = 1").drop("_n")
        # Those that left stay as marks, or an older change that comes late would bring them back.
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/{number:08d}")
        versions = self.versions(number - 1) | dict.fromkeys(touched, number)
        listed = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list/{number:08d}")
        before, now = held.drop("touched"), self.marked(number, touched).filter(F.col("touched") == number).drop("touched").dropna(subset=self.keys)
        if self.read_rows:
            before = before.join(now.select(*self.keys), self.keys, "left_semi")
        return before.filter("NOT gone"), now.filter("NOT gone")

    def groups(self, number: int, changed: DataFrame) -> DataFrame:
        """All rows of the groups of a batch's changed rows, from the buckets it wrote."""
        bucket = F.pmod(F.xxhash64(self.group), F.lit(self.buckets)).cast("int")
        touched = {r.bucket for r in changed.select(bucket.alias("bucket")).distinct().collect()}
        rows = self.rows(number, touched)
        # Where nothing was held before, the buckets hold the changed groups alone.
        return (rows.join(changed.select(self.group).distinct(), self.group, "left_semi") if self.read_rows else rows.dropna(subset=[self.group])).filter("NOT gone")


def grouped_view(spark: SparkSession, changes: DataFrame, group: str, item: str, schema: str, view: Callable[[DataFrame], DataFrame], folder: str | None = None, after: Callable[[int, DataFrame, int], None] | None = None) -> DataFrame:
    """view(rows) of a change log (the columns of schema, at, gone), kept up batch by batch.

    ``after`` is told each batch's number, the whole view and the rows the batch read.
    """
    folder = folder or new_folder(spark, "view")
    kept, last = Kept(spark, f"{folder}/kept", group, item, schema), []

    def step(batch: DataFrame, number: int) -> None:
        kept.apply(batch, number)
        last[:] = [number]
        if after is not None:
            after(number, view(kept.rows(number).filter("NOT gone")), kept.read_rows)

    drain(changes, step, state=f"{folder}/stream")
    return view(kept.rows(last[0] if last else -1).filter("NOT gone"))


FACE = "face_id string, cluster_id long, quality_tier string, quality_score double, match_score double, area double"
ORDER = ("less_score", "less_match", "less_area", "best")


class PersonsWithFace:
    """Visible persons with their best face, kept up from changes of faces, clusters and persons.

    Faces are kept by face, so that a face that moves leaves its old cluster; members by cluster, where a cluster's own row and
    its faces meet; the best face of each cluster by person, where the person's own row waits. Each step hands
    on only what changed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        folder = folder or new_folder(spark, "persons-with-face")
        self.faces = Kept(spark, f"{folder}/faces", "face_id", "face_id", FACE)
        self.members = Kept(spark, f"{folder}/members", "cluster_id", "item", "item string, person_id long, " + FACE)
        self.persons = Kept(spark, f"{folder}/persons", "person_id", "item", "person_id long, item string, name string, photo_count long, hidden boolean, less_score double, less_match double, less_area double, best string")

    def apply(self, faces: DataFrame, clusters: DataFrame, persons: DataFrame, number: int) -> None:
        """faces: FACE, at, gone; clusters: cluster_id, person_id, at, gone; persons: person_id, name, photo_count, hidden, at, gone."""
        at = F.lit(number).cast("long")
        before, now = self.faces.apply(faces, number)
        moved = before.withColumnRenamed("cluster_id", "_old").join(now.select("face_id", F.col("cluster_id").alias("_new")), "face_id", "left").filter("_old IS NOT NULL AND NOT (_old <=> _new)")
        left = moved.withColumn("cluster_id", F.col("_old")).withColumn("gone", F.lit(True)).select(*before.columns)
        nobody, face = F.lit(None).cast("long").alias("person_id"), F.concat(F.lit("f"), F.col("face_id")).alias("item")
        members = now.filter("cluster_id IS NOT NULL").unionByName(left).select("*", face, nobody).withColumn("at", at)
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("face_id", "string"), ("quality_tier", "string"), ("quality_score", "double"), ("match_score", "double"), ("area", "double"))]
        own = clusters.select("cluster_id", F.lit("c").alias("item"), "person_id", "gone", at.alias("at"), *empty)
        was, _ = self.members.apply(members.unionByName(own), number)
        # Clusters that changed in any way say anew whose they are and which face is their best.
        changed = self.members.groups(number, self.members.changes(number))
        best = F.min(F.when(F.col("item") != "c", F.when(F.col("quality_tier").isin("ANCHOR", "CLUSTERING"), F.struct((-F.col("quality_score")).alias("less_score"), (-F.coalesce("match_score", F.lit(0.0))).alias("less_match"), (-F.col("area")).alias("less_area"), F.col("face_id").alias("best")))))
        found = changed.groupBy("cluster_id").agg(best.alias("b"), F.max("person_id").alias("person_id")).select("person_id", F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("item"), "b.*")
        fresh = found.filter("person_id IS NOT NULL AND best IS NOT NULL").withColumn("gone", F.lit(False))
        # Persons that the clusters belonged to before the batch, and those they belong to now.
        owners = was.unionByName(changed).filter("item = 'c' AND person_id IS NOT NULL").select("person_id", F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("item")).distinct()
        lost = owners.join(fresh.select("person_id", "item"), ["person_id", "item"], "left_anti").select("person_id", "item", *(F.lit(None).cast("string" if c == "best" else "double").alias(c) for c in ORDER), F.lit(True).alias("gone"))
        about = [F.lit(None).cast(kind).alias(name) for name, kind in (("name", "string"), ("photo_count", "long"), ("hidden", "boolean"))]
        people = persons.select("person_id", F.lit("p").alias("item"), "name", "photo_count", "hidden", "gone", *(F.lit(None).cast("string" if c == "best" else "double").alias(c) for c in ORDER))
        self.persons.apply(fresh.unionByName(lost).select("*", *about).unionByName(people).withColumn("at", at), number)

    def view(self, number: int) -> DataFrame:
        """person_id, name, photo_count, face_id of visible persons that have a face."""
        rows = self.persons.rows(number).filter("NOT gone")
        best = rows.filter("item <> 'p'").groupBy("person_id").agg(F.min(F.struct(*ORDER)).alias("b")).select("person_id", F.col("b.best").alias("face_id"))
        return rows.filter("item = 'p' AND NOT hidden").select("person_id", "name", "photo_count").join(best, "person_id")


def faces_as_changes(faces: DataFrame, at: str) -> DataFrame:
    """Face rows of the tables as changes; deleted ones leave."""
    area = (F.col("bbox_right") - F.col("bbox_left")) * (F.col("bbox_bottom") - F.col("bbox_top"))
    kinds = {"quality_score": "double", "match_score": "double", "cluster_id": "long"}
    return faces.withColumn("area", area.cast("double")).select(*(F.col(f.split()[0]).cast(kinds.get(f.split()[0], f.split()[1])).alias(f.split()[0]) for f in FACE.split(", ")), F.expr(at).cast("long").alias("at"), F.col("deleted").alias("gone"))
