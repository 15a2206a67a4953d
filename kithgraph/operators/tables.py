"""Reading, writing and filtering of keyed tables. Changes are tables too: one job applies any number."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.sources.storage import saved


def ingest_catalog(listing: DataFrame) -> DataFrame:
    """Listing (photo_id, size_bytes, seconds) without empty files, times from seconds, newest first."""
    kept = listing.filter(F.col("size_bytes") > 0)
    return kept.select("photo_id", F.timestamp_seconds("seconds").alias("date_added"), F.lit("PENDING").alias("scan_status")).orderBy(F.col("date_added").desc(), "photo_id")


def insert_ignore(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    fresh = new.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order, then by all other columns."""
    rest = [F.col(c).desc() for c in df.columns if c not in (key, order)]
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), *rest)))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    last = latest(new, key, order).select(*target.columns)
    return target.join(last.select(key), key, "left_anti").select(*target.columns).unionByName(last)


def update_from(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Take columns from changes where it has the key, nulls included; changes has one row a key."""
    new = changes.select(key, F.lit(True).alias("_present"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, key, "left")
    return joined.select(*[F.when(F.col("_present"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def reassign(df: DataFrame, mapping: DataFrame, column: str, live_only: bool = True) -> DataFrame:
    """Replace values of a column by mapping (old, new)."""
    joined = df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    moved = F.coalesce("_new", column)
    if live_only and "deleted" in df.columns:
        moved = F.when(F.col("deleted"), F.col(column)).otherwise(moved)
    return joined.select(*[moved.alias(c) if c == column else F.col(c) for c in df.columns])


#: child table, its key into the parent, what happens to it
CASCADES = {
    "photos": [("faces", "photo_id", "delete")],
    "clusters": [("anchors", "cluster_id", "delete"), ("representatives", "cluster_id", "delete"), ("statistics", "cluster_id", "delete")],
    "persons": [("clusters", "person_id", "null")],
}
KEYS = {"photos": "photo_id", "clusters": "cluster_id", "persons": "person_id", "faces": "face_id"}


def delete_cascade(tables: dict[str, DataFrame], table: str, where: Column) -> dict[str, DataFrame]:
    """Delete rows and act on the tables that refer to them."""
    key = KEYS[table]
    gone = tables[table].filter(where).select(key)
    out = tables | {table: tables[table].join(gone, key, "left_anti")}
    for child, column, action in CASCADES.get(table, []):
        if child in tables:
            ends = gone.select(F.col(key).alias(column))
            if action == "delete":
                out[child] = tables[child].join(ends, column, "left_anti").select(*tables[child].columns)
            else:
                marked = tables[child].join(ends.withColumn("_gone", F.lit(True)), column, "left")
                out[child] = marked.select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in tables[child].columns])
    return out


def soft_delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return update_from(df, ids.select(key, F.lit(True).alias("deleted")), key, ["deleted"])


def restore(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return update_from(df, ids.select(key, F.lit(False).alias("deleted")), key, ["deleted"])


def purge(df: DataFrame, spent: Column) -> DataFrame:
    """Drop the rows that a retention rule has spent; unknown is kept."""
    return df.filter(~F.coalesce(spent, F.lit(False)))


def apply_increments(df: DataFrame, deltas: DataFrame, key: str, counter: str) -> DataFrame:
    added = deltas.groupBy(key).agg(F.count("*").alias("_n"))
    joined = df.join(added, key, "left")
    return joined.select(*[(F.col(c) + F.coalesce("_n", F.lit(0))).alias(c) if c == counter else F.col(c) for c in df.columns])


def write_snapshot(tables: dict[str, DataFrame], path: str, version: int, keys: dict[str, str], buckets: int = 16) -> None:
    """Write all tables of a version, each by a hash of its key, then the pointer that makes it current.

    The pointer is a folder of its own, which counts once its job has committed, so a reader sees one version whole.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.withColumn("bucket", F.pmod(F.xxhash64(keys[name]), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{version}/{name}")
    pointer = spark.createDataFrame([(version, json.dumps(sorted(tables)))], "version int, tables string")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/current/version={version}")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    current = spark.read.parquet(f"{path}/current/*").orderBy(F.col("version").desc()).first()
    return {name: spark.read.parquet(f"{path}/v{current.version}/{name}").drop("bucket") for name in json.loads(current.tables)}


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("deleted"))


def lookup(df: DataFrame, key: str, ids: DataFrame, include_deleted: bool = False) -> DataFrame:
    found = df.join(ids.select(key).distinct(), key, "left_semi")
    return found if include_deleted or "deleted" not in df.columns else live(found)


def unassigned(df: DataFrame, column: str, require: str | None = None) -> DataFrame:
    found = live(df).filter(F.col(column).isNull())
    return found.filter(F.col(require).isNotNull()) if require else found


def by_status(df: DataFrame, status: str, order: list[Column], limit: int | None = None) -> DataFrame:
    found = df.filter(F.col("scan_status" if "scan_status" in df.columns else "status") == status).orderBy(*order)
    return found.limit(limit) if limit is not None else found


def range_filter(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        df = df.filter(F.col(column) >= low)
    return df.filter(F.col(column) <= high) if high is not None else df


def conflicting(staged: DataFrame, gap: float = 0.15) -> DataFrame:
    near = F.col("candidate_similarity") - F.col("conflicting_similarity") < gap
    return staged.filter((F.col("status") == "PENDING") & F.col("conflicting_cluster_id").isNotNull() & near)


def anchors(df: DataFrame, active: bool | None = True, pose: str | None = None) -> DataFrame:
    if active is not None:
        df = df.filter(F.col("is_active") == active)
    return df.filter(F.col("pose_category") == pose) if pose else df


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def exists_many(df: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """probes with ``found``."""
    known = df.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return probes.join(known, keys, "left").select(*probes.columns, F.col("_hit").isNotNull().alias("found"))


def partners(constraints: DataFrame, kind: str | None = None) -> DataFrame:
    """face_id and the other side of each of its constraints."""
    own = constraints.filter(F.col("constraint_type") == kind) if kind else constraints
    there = own.select(F.col("face_id1").alias("face_id"), F.col("face_id2").alias("partner"), "constraint_type")
    back = own.select(F.col("face_id2").alias("face_id"), F.col("face_id1").alias("partner"), "constraint_type")
    return there.unionByName(back)


def history_of(history: DataFrame, cluster_id: int) -> DataFrame:
    """Operations on a cluster as target or source, newest first."""
    return history.filter((F.col("cluster_id") == cluster_id) | (F.col("source_cluster_id") == cluster_id)).orderBy(F.col("ts").desc(), F.col("history_id").desc())


def undoable(history: DataFrame, now: str, limit: int) -> DataFrame:
    open_still = ~F.col("expires") | (F.col("ts") + F.expr("INTERVAL 30 DAYS") > F.lit(now).cast("timestamp_ntz"))
    return history.filter(F.col("can_undo") & open_still).orderBy(F.col("ts").desc(), F.col("history_id").desc()).limit(limit)


def search_persons(persons: DataFrame, text: str) -> DataFrame:
    """Case-insensitive part of the name; a blank search finds all, otherwise a missing name never fits."""
    wanted = text.strip().lower()
    return persons if not wanted else persons.filter(F.lower("name").contains(wanted))


def search_any(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.filter(test)


def display_name() -> Column:
    return F.coalesce("name", F.concat(F.lit("Person "), F.coalesce(F.col("display_number").cast("string"), F.lit("?"))))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: object, limit: int) -> DataFrame:
    """Keyset form for deep pages: the first rows after a key."""
    return df.filter(F.col(key) > last).orderBy(key).limit(limit)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


#: Rows of a part of the range that one task sums in order; a part may be twice as large.
PART_ROWS = 1 << 20


def in_parts(df: DataFrame, order: list[str], rows: int = PART_ROWS) -> DataFrame:
    """df with ``_part``, saved: ranges of the order, none of them much more than ``rows`` rows.

    Spark's range partitioning samples its bounds, so parts are counted, and those of more than twice the rows are cut again.
    The order has to tell rows apart; a column of ties is cut by the next one.
    """
    n = df.count()
    if n <= rows:
        return saved(df.withColumn("_part", F.array(F.lit(0))))
    here = F.spark_partition_id()
    placed = saved(df.repartitionByRange(-(-n // rows), *order).withColumn("_part", F.array(here)))
    while True:
        sizes = saved(placed.groupBy("_part").agg(F.count("*").alias("_n")))
        large = sizes.filter(F.col("_n") > 2 * rows)
        more = large.agg(F.sum(F.ceil(F.col("_n") / rows))).first()[0]
        if not more:
            return placed
        cut = placed.join(large.select("_part"), "_part", "left_semi").repartitionByRange(int(more) + 1, "_part", *order)
        cut = cut.withColumn("_part", F.concat("_part", F.array(here)))
        placed = saved(placed.join(large.select("_part"), "_part", "left_anti").select(*cut.columns).unionByName(cut))


def running_total(df: DataFrame, order: str | list[str], value: Column, name: str, rows: int = PART_ROWS) -> DataFrame:
    """df (one row for each value of the order) with the sum of value up to and with it.

    Parts of the range sum side by side; only the part totals meet in one task.
    """
    order = [order] if isinstance(order, str) else order
    cut = in_parts(df.withColumn("_value", value), order, rows)
    totals = cut.groupBy("_part").agg(F.sum("_value").alias("_sum"), F.min(F.struct(*order)).alias("_first"))
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(W.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_own", own).join(before, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_value", "_own", "_before")


def chunks(df: DataFrame, order: str, n: int) -> DataFrame:
    """df (unique, numeric order) with the number of its chunk of n rows."""
    return running_total(df, order, F.lit(1), "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / n)).drop("_place")
