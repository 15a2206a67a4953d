"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    """Unequal sizes give 0; the result stays within -1 and 1."""
    raw = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    raw = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (both > 0), raw / both).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))).otherwise(F.lit(1.7976931348623157e308))


def l2_normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    # Inside a lambda the size would be computed anew for each element, so it is bound first.
    bound = F.array(F.struct(a.alias("a"), norm(a).alias("size")))
    return F.transform(bound, lambda b: F.transform(b["a"], lambda x: F.when(b["size"] > 0, x.cast("double") / b["size"]).otherwise(x.cast("double"))))[0]


def vector_sums(df: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """key, n and the element-wise (weighted) sum; partial sums travel, not vectors."""
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(key, w.cast("double").alias("_w"), array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    return rows.groupBy(key).agg(F.sum("_w").alias("n"), vector_to_array(Summarizer.sum(F.col("_x"), F.col("_w"))).alias("total"))


def centroids(df: DataFrame, key: str, vector: str, normalize: bool = False) -> DataFrame:
    summed = vector_sums(df, key, vector)
    mean = F.transform("total", lambda x: x / F.col("n"))
    out = summed.select(key, F.col("n").cast("long").alias("n"), mean.alias("centroid"))
    return out.withColumn("centroid", l2_normalize(F.col("centroid"))) if normalize else out


def medoids(df: DataFrame, key: str, member: str, vector: str, bonus: Column | None = None) -> DataFrame:
    """The member of each group most similar to the others, by sums instead of pairs.

    For unit vectors the mean similarity to the others is (e . total - e . e) / (n - 1); a group of one is
    its own medoid. Ties go to the smaller member.
    """
    best = F.min_by(F.struct(F.col(member).alias("member"), "score"), F.struct(-F.col("score"), F.col(member)))
    return scored_members(df, key, vector, bonus).groupBy(key).agg(best.alias("b")).select(key, F.col("b.member").alias(member), F.col("b.score").alias("score"))


def quality_medoids(df: DataFrame, key: str, member: str, vector: str, quality: str, eligible: Column) -> DataFrame:
    """The eligible member with the greatest mean similarity plus half its quality share; without one, the best quality and no score."""
    scored = scored_members(df, key, vector, F.col(quality) / 100 * 0.5)
    order = F.struct((~eligible).alias("_out"), -F.when(eligible, F.col("score")).otherwise(F.col(quality)), F.col(member))
    best = F.min_by(F.struct(F.col(member).alias("member"), F.when(eligible, F.col("score")).alias("score")), order)
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.member").alias(member), F.col("b.score").alias("score"))


def scored_members(df: DataFrame, key: str, vector: str, bonus: Column | None) -> DataFrame:
    """df with the score of each member: its mean similarity to the others of its group, plus the bonus."""
    summed = vector_sums(df, key, vector).select(key, "n", "total")
    own = total(F.zip_with(vector, "total", lambda x, y: x.cast("double") * y)) - total(F.transform(vector, lambda x: x.cast("double") * x))
    score = F.when(F.col("n") > 1, own / (F.col("n") - 1)).otherwise(1.0)
    return df.join(summed, key).withColumn("score", F.round(score + (bonus if bonus is not None else F.lit(0.0)), 9))
