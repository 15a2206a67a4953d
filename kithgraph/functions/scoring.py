"""Face quality, pose and match rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds that results depend on.
ANCHOR_QUALITY, CLUSTERING_QUALITY, DISPLAY_QUALITY = 65, 50, 35
ANCHOR_SHARPNESS, CLUSTERING_SHARPNESS, ANCHOR_EYES = 15, 10, 6
FRONTAL_YAW, SLIGHT_YAW = 15, 35
DEFINITE, LIKELY, UNCERTAIN = 0.62, 0.52, 0.42
SAFE_SAME, UNCERTAIN_LOW = 0.62, 0.35
MERGE, SUGGEST, MATCH = 0.75, 0.45, 0.58
DECISION_GAP, CONFLICT_GAP = 0.08, 0.15
MATURE_SIZE, GROWING_SIZE, MATURITY_STEP = 10, 5, 0.05
POSES = ("FRONTAL", "SLIGHT_LEFT", "SLIGHT_RIGHT", "PROFILE_LEFT", "PROFILE_RIGHT")

TIER_SQL = (
    "CASE WHEN {score} >= 65 AND {sharpness} >= 15 AND {eye} >= 6 THEN 'ANCHOR' "
    "WHEN {score} >= 50 AND {sharpness} >= 10 THEN 'CLUSTERING' WHEN {score} >= 35 THEN 'DISPLAY_ONLY' ELSE 'REJECTED' END"
)
POSE_SQL = (
    "CASE WHEN {yaw} < -35 THEN 'PROFILE_LEFT' WHEN {yaw} < -15 THEN 'SLIGHT_LEFT' WHEN {yaw} <= 15 THEN 'FRONTAL' "
    "WHEN {yaw} <= 35 THEN 'SLIGHT_RIGHT' ELSE 'PROFILE_RIGHT' END"
)


def quality_tier(score: str, sharpness: str, eye: str) -> Column:
    s, sharp = F.col(score), F.col(sharpness)
    return (
        F.when((s >= ANCHOR_QUALITY) & (sharp >= ANCHOR_SHARPNESS) & (F.col(eye) >= ANCHOR_EYES), "ANCHOR")
        .when((s >= CLUSTERING_QUALITY) & (sharp >= CLUSTERING_SHARPNESS), "CLUSTERING")
        .when(s >= DISPLAY_QUALITY, "DISPLAY_ONLY")
        .otherwise("REJECTED")
    )


def tier_flags(tier: str) -> dict[str, Column]:
    """What a face of a tier may do."""
    t = F.col(tier)
    good = t.isin("ANCHOR", "CLUSTERING")
    return {"can_form": t == "ANCHOR", "can_join": good, "can_update_centroid": good, "stored": t != "REJECTED", "visible": t != "REJECTED"}


def anchor_eligible(score: str, sharpness: str, yaw: str, eye: str, null_yaw: str = "fail") -> Column:
    """A missing yaw fails (it counts as 45 degrees) or passes."""
    turned = F.coalesce(F.abs(F.col(yaw)), F.lit(45.0 if null_yaw == "fail" else 0.0))
    return (F.col(score) >= ANCHOR_QUALITY) & (F.col(sharpness) >= ANCHOR_SHARPNESS) & (turned <= 20) & (F.col(eye) >= 7)


def pose(yaw: Column) -> Column:
    return F.when(yaw < -SLIGHT_YAW, "PROFILE_LEFT").when(yaw < -FRONTAL_YAW, "SLIGHT_LEFT").when(yaw <= FRONTAL_YAW, "FRONTAL").when(yaw <= SLIGHT_YAW, "SLIGHT_RIGHT").otherwise("PROFILE_RIGHT")


def poses_adjacent(a: Column, b: Column) -> Column:
    """Poses next to each other on the line from left profile to right profile."""
    order = F.create_map(*[x for i, p in enumerate(("PROFILE_LEFT", "SLIGHT_LEFT", "FRONTAL", "SLIGHT_RIGHT", "PROFILE_RIGHT")) for x in (F.lit(p), F.lit(i))])
    return F.abs(order[a] - order[b]) <= 1


def bridge_confidence(sim: Column, a: Column, b: Column) -> Column:
    frontal = ((a == "FRONTAL") | (b == "FRONTAL")) & poses_adjacent(a, b)
    bonus = F.when(a == b, 0.15).when(frontal, 0.12).when(poses_adjacent(a, b), 0.08).otherwise(0.03)
    return F.least(F.greatest(sim + bonus, F.lit(0.0)), F.lit(1.0))


def bridge_bonus(a: str, b: str) -> float:
    """What ``bridge_confidence`` adds for two poses."""
    near = {frozenset(p) for p in (("FRONTAL", "SLIGHT_LEFT"), ("FRONTAL", "SLIGHT_RIGHT"), ("SLIGHT_LEFT", "PROFILE_LEFT"), ("SLIGHT_RIGHT", "PROFILE_RIGHT"))}
    return 0.15 if a == b else 0.03 if frozenset((a, b)) not in near else 0.12 if "FRONTAL" in (a, b) else 0.08


def match_zone(sim: Column) -> Column:
    return F.when(sim >= DEFINITE, "HIGH").when(sim >= LIKELY, "MEDIUM").when(sim >= UNCERTAIN, "STAGED").otherwise("NEW_CLUSTER")


def three_zones(sim: Column) -> Column:
    return F.when(sim >= SAFE_SAME, "SAFE_SAME").when(sim >= UNCERTAIN_LOW, "UNCERTAIN").otherwise("SAFE_DIFFERENT")


def maturity(size: Column) -> Column:
    return F.when(size >= MATURE_SIZE, "MATURE").when(size >= GROWING_SIZE, "GROWING").otherwise("NEW")


def adaptive_threshold(base: float, size: Column) -> Column:
    return F.when(size >= MATURE_SIZE, base - MATURITY_STEP).when(size >= GROWING_SIZE, F.lit(base)).otherwise(base + MATURITY_STEP)


def weighted_similarity(sim: Column, quality: Column) -> Column:
    """Similarity moved by quality, at most .08 either way, within -1 and 1."""
    share = F.least(F.greatest(quality / 100.0, F.lit(0.0)), F.lit(1.0))
    boost = F.least(F.greatest((share - 0.5) * 0.2, F.lit(-0.08)), F.lit(0.08))
    return F.when(sim.isNotNull() & quality.isNotNull(), F.least(F.greatest(sim + boost, F.lit(-1.0)), F.lit(1.0)))


def merge_label(sim: Column) -> Column:
    return F.when(sim >= 0.62, "likely").when(sim >= 0.58, "possible").otherwise("uncertain")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def steps(x: Column, *pairs: tuple[float, float], least: float = 0.0) -> Column:
    """The value of the first step that x reaches, from the highest down."""
    out = F.when(x >= pairs[0][0], float(pairs[0][1]))
    for at, value in pairs[1:]:
        out = out.when(x >= at, float(value))
    return out.otherwise(float(least))


#: source, safe-same, uncertain-low, second-pass high, second-pass several anchors, adjustment (fixed values)
SOURCES = (
    ("FACENET_512", 0.62, 0.35, 0.50, 0.45, 0.0),
    ("MOBILEFACENET_192", 0.58, 0.42, 0.52, 0.45, -0.05),
    ("HASH_FALLBACK", 0.85, 0.70, 0.85, 0.70, 0.20),
    ("UNKNOWN", 0.62, 0.35, 0.62, 0.55, 0.0),
)


def size_score(pixels: Column) -> Column:
    return steps(pixels, (200, 25), (150, 22), (100, 18), (80, 14), (60, 8), (40, 4))


def pose_score(yaw: Column, roll: Column, most_yaw: float = 30.0, most_roll: float = 25.0) -> Column:
    """25 points less penalties for turning and tilting the head."""
    y, r = F.abs(yaw), F.abs(roll)
    turned = F.when(y > 45, 20.0).when(y > most_yaw, 10 + (y - most_yaw) * 0.4).when(y > 15, 3 + (y - 15) * 0.3).otherwise(y * 0.1)
    tilted = F.when(r > 35, 10.0).when(r > most_roll, 5 + (r - most_roll) * 0.3).otherwise(r * 0.1)
    return clamp(25 - turned - tilted, 0, 25)


def sharpness_score(variance: Column) -> Column:
    """Points for the variance of the Laplacian, linear between steps."""
    v = variance
    return clamp(
        F.when(v >= 500, 25.0).when(v >= 300, 22 + (v - 300) / 66.0).when(v >= 150, 18 + (v - 150) / 37.5).when(v >= 80, 12 + (v - 80) / 11.7)
        .when(v >= 40, 6 + (v - 40) / 6.7).when(v >= 15, 2 + (v - 15) / 6.25).otherwise(v / 7.5), 0, 25,
    )


def brightness_score(mean: Column, contrast: Column) -> Column:
    light = (
        F.when(mean.between(100, 160), 10.0).when(mean.between(80, 180), 8.0).when(mean.between(60, 200), 5.0).when(mean.between(40, 220), 3.0)
        .when((mean < 30) | (mean > 230), 0.0).otherwise(1.0)
    )
    return clamp(light + steps(contrast, (150, 5), (100, 4), (70, 3), (40, 2)), 0, 15)


def eye_open_points(probability: Column) -> Column:
    """An unknown eye gets the benefit of the doubt."""
    return F.when(probability.isNull(), 1.0).when(probability > 0.8, 2.0).when(probability > 0.5, 1.5).when(probability > 0.3, 0.5).otherwise(0.0)


def eye_score(left: Column, right: Column, apart: Column) -> Column:
    """Points for two landmarks, open eyes and their distance in pixels."""
    return clamp(3 + eye_open_points(left) + eye_open_points(right) + F.when(apart > 30, 2.0).when(apart > 20, 1.5).when(apart > 10, 1.0).otherwise(0.0), 0, 10)


def position_score(left: Column, top: Column, right: Column, bottom: Column, width: int, height: int, margin: float = 0.03) -> Column:
    """Up to 5 points for a face in the middle; none near an edge."""
    away = F.abs((left + right) / 2 / width - 0.5) + F.abs((top + bottom) / 2 / height - 0.5)
    edge = (left / width < margin) | (top / height < margin) | ((width - right) / width < margin) | ((height - bottom) / height < margin)
    return F.when(edge, 0.0).otherwise(clamp((1 - away) * 5, 0, 5))


def usable_boxes(boxes: DataFrame, width: int, height: int, least: int = 50, padding: float = 0.25, most_clip: float = 0.20) -> DataFrame:
    """Boxes (l, t, r, b in pixels) large enough, not too narrow and mostly inside, with their share outside, normalised sides and crop."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    fit = boxes.filter((w >= least) & (h >= least) & (w / h).between(0.5, 2))
    inside = F.greatest(F.least("r", F.lit(width)) - F.greatest("l", F.lit(0)), F.lit(0)) * F.greatest(F.least("b", F.lit(height)) - F.greatest("t", F.lit(0)), F.lit(0))
    clip = 1 - inside / (w * h)
    whole = lambda c: c.cast("int")
    return fit.filter(F.round(clip, 9) <= most_clip).select(
        "face_id", F.round(clip, 6).cast("double").alias("clip"), F.round(clamp(F.col("l") / width, 0, 1), 6).cast("double").alias("norm_left"), F.round(clamp(F.col("r") / width, 0, 1), 6).cast("double").alias("norm_right"),
        F.greatest(whole(F.col("l") - w * padding), F.lit(0)).alias("crop_left"), F.greatest(whole(F.col("t") - h * padding), F.lit(0)).alias("crop_top"),
        F.least(whole(F.col("r") + w * padding), F.lit(width)).alias("crop_right"), F.least(whole(F.col("b") + h * padding), F.lit(height)).alias("crop_bottom"),
    )


def split_confidence(variance: Column, spread: Column, groups: Column) -> Column:
    parts = F.when(groups >= 3, 1.0).when(groups == 2, 0.7).otherwise(0.3)
    return clamp(variance - 0.05, 0, 0.15) / 0.15 * 0.4 + clamp(spread - 0.25, 0, 0.35) / 0.35 * 0.3 + parts * 0.3


def merge_confidence(centroid: Column, representative: Column) -> Column:
    return clamp(centroid - 0.5, 0, 0.3) / 0.3 * 0.3 + clamp(representative - 0.55, 0, 0.25) / 0.25 * 0.7


def optimal_duration(count: Column, longest: Column) -> Column:
    target = F.when(count <= 5, 30.0).when(count <= 10, 45.0).otherwise(60.0)
    return F.least(F.greatest(target / count, F.lit(1.0)), longest)


def clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))
