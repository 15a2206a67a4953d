"""Photo, face, cluster and person tables derived from the driver's tables.

Each view is a list of SQL expressions that mean the same in Spark and DuckDB, so both sides start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kithgraph.functions import scoring

FACE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int))"
PERSONS = "{persons}"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_photos": (
        "orders",
        [
            "o_orderkey AS photo_id",
            "o_orderdate AS date_added",
            "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS date_taken",
            "o_orderpriority AS bucket_name",
            "CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'SCANNED' ELSE 'NO_FACES' END AS scan_status",
            "o_custkey % 500 AS album_id",
            "cast(floor(o_totalprice) AS bigint) % 1000 AS size_bytes",
        ],
    ),
    "v_faces": (
        "lineitem",
        [
            f"{FACE_ID} AS face_id",
            "l_orderkey AS photo_id",
            "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey END AS cluster_id",
            "l_quantity * 2 AS quality_score",
            "CASE WHEN l_linenumber = 7 THEN NULL ELSE round(1 - (l_discount + 0.0), 2) END AS match_score",
            "l_suppkey % 11 AS eye_visibility_score",
            "l_partkey % 26 AS sharpness_score",
            "l_partkey % 181 - 90 AS euler_y",
            "l_returnflag = 'R' AS deleted",
            "l_shipdate AS deleted_at",
            "0.5 + l_tax AS confidence",
            "l_tax AS bbox_left",
            "l_tax * 0.5 AS bbox_top",
            "l_tax + 0.1 + (l_discount + 0.0) AS bbox_right",
            "l_tax * 0.5 + 0.2 AS bbox_bottom",
            "CASE WHEN l_suppkey % 3 = 0 THEN 'FACENET_512' WHEN l_suppkey % 3 = 1 THEN 'MOBILEFACENET_192' ELSE 'HASH_FALLBACK' END AS embedding_source",
            "l_tax * 10 AS alignment_quality",
            scoring.TIER_SQL.format(score="l_quantity * 2", sharpness="l_partkey % 26", eye="l_suppkey % 11") + " AS quality_tier",
        ],
    ),
    "v_clusters": (
        "part",
        [
            "p_partkey AS cluster_id",
            f"CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_partkey % {PERSONS} END AS person_id",
            "p_size % 13 = 0 AS deleted",
            "p_size AS face_count",
            "p_partkey % 97 AS created_at",
            "p_partkey % 89 AS updated_at",
        ],
    ),
    "v_persons": (
        "supplier",
        [
            "s_suppkey AS person_id",
            "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name",
            "s_acctbal < 0 AS is_hidden",
            "s_suppkey % 11 = 0 AS deleted",
            "s_suppkey % 37 AS created_at",
            "s_suppkey * 7 % 50 AS photo_count",
            "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey + 1 END AS display_number",
            "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat(lpad(cast(1 + s_suppkey % 12 AS varchar(2)), 2, '0'), '-', lpad(cast(1 + s_suppkey % 28 AS varchar(2)), 2, '0')) END AS birthday",
        ],
    ),
    "v_history": (
        "events",
        [
            "event_id AS history_id",
            "ts",
            "CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'MOVE_FACE' WHEN 'view' THEN 'RENAME' WHEN 'purchase' THEN 'MERGE' ELSE 'DELETE' END AS operation_type",
            "user_id AS cluster_id",
            "CASE WHEN event_id % 3 = 0 THEN user_id + 1 END AS source_cluster_id",
            "value < 20 AS can_undo",
            "event_id % 5 <> 0 AS expires",
            "value",
        ],
    ),
    "v_images": (
        "events",
        ["user_id AS album_id", "event_id AS image_id", "ts AS date_taken", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS place_name", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS duration_s"],
    ),
    "v_anchors": (
        "lineitem",
        [
            f"{FACE_ID} AS anchor_id",
            "l_partkey AS cluster_id",
            "l_quantity * 2 AS quality_score",
            "l_partkey % 26 AS sharpness_score",
            scoring.POSE_SQL.format(yaw="((l_orderkey * 7 + l_linenumber * 31) % 181 - 90)") + " AS pose_category",
            "l_linestatus = 'O' AS is_active",
            "l_shipdate AS created_at",
        ],
    ),
    "v_staged": (
        "lineitem",
        [
            f"{FACE_ID} AS face_id",
            "l_partkey AS candidate_cluster_id",
            "l_orderkey AS photo_id",
            "l_discount + 0.4 AS candidate_similarity",
            "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_partkey + 1 END AS conflicting_cluster_id",
            "l_tax + 0.3 AS conflicting_similarity",
            "l_shipdate AS created_at",
            "l_quantity AS quality_score",
            "CASE l_linestatus WHEN 'O' THEN 'PENDING' ELSE CASE l_returnflag WHEN 'R' THEN 'REJECTED' WHEN 'A' THEN 'VERIFIED' ELSE 'COMMITTED' END END AS status",
        ],
    ),
    "v_statistics": (
        "part",
        ["p_partkey AS cluster_id", "p_retailprice / 4000 AS acceptance_threshold", "p_size * 0.01 AS variance_similarity", "p_size * 0.02 AS min_similarity", "p_partkey % 120 AS last_updated", "p_size % 9 AS anchor_count"],
    ),
    "v_constraints": (
        "lineitem",
        [f"{FACE_ID} AS face_id1", "concat('x-', cast(l_orderkey % 50 AS varchar(20))) AS face_id2", "CASE WHEN l_linenumber % 3 = 0 THEN 'MUST_LINK' ELSE 'CANNOT_LINK' END AS constraint_type"],
    ),
}


class Frames:
    """Views by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        source, columns = VIEWS[f"v_{name}"]
        if any(PERSONS in c for c in columns):
            count = self.table("supplier").count()
            columns = [c.replace(PERSONS, str(count)) for c in columns]
        return self.table(source).selectExpr(*columns)


def duckdb_views() -> str:
    """The views as the head of a WITH query."""
    parts = [f"{name} AS (SELECT {', '.join(columns)} FROM {source})" for name, (source, columns) in VIEWS.items()]
    return "WITH " + ",\n".join(parts).replace(PERSONS, "(SELECT count(*) FROM supplier)")
