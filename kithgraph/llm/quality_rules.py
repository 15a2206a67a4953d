"""Quality rules: counts over words and lines, and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words fall into hashed buckets. Two smoothed multinomials over the buckets
are counted, one over all documents (raw) and one over the trusted ones (labelled of good quality and not
toxic). A document's score is the mean over its n-grams of log p_trusted - log p_raw; it is kept if no base
rule fails and the score reaches the threshold. Everything is DataFrame expressions.

Defined results: null text has no words and fails the base rule; without trusted documents all scores are 0;
null doc_id is kept as it is and has no label; repeated rows are judged alike and each counts in the raw
multinomial; repeated labels count once, a document with any untrusting label is not trusted; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import table

BUCKETS = 8192
#: The trusted multinomial is fitted on so many labelled documents at most; the raw one on all documents.
TRUSTED_DOCUMENTS = 20_000
#: The trusted multinomial is smoothed by so many n-grams a bucket, spread like the raw one.
PRIOR = 20
#: Nats per n-gram; documents like the trusted ones score about 0.01 or more.
THRESHOLD = -0.03
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), "")


def neighbours(hashes: str, n: int) -> Column:
    """Hashes of all runs of n neighbours in an array column of hashes."""
    out = F.col(hashes)
    for i in range(1, n):
        shifted = F.slice(F.col(hashes), F.lit(i + 1), F.greatest(F.size(hashes) - i, F.lit(0)))
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(F.size(hashes) - i, F.lit(0))), shifted, lambda a, b: F.xxhash64(a, b))
    return out


def repeated_words(triples: Column, n_words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Each window's hash gives its lower bits to the upper part of a number whose lower part is the window's
    place, so one sort of numbers brings equal windows together. In long texts these bits are few; so what is
    found is only a choice of windows, which are then compared by their whole hashes.
    """
    bits = F.ceil(F.log2(n_words + F.lit(1.0))).cast("int")
    mask = F.expr("shiftleft(1L, cast(ceil(log2(n_words + 1.0D)) as int))") - 1

    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(high(a) == high(b), F.lit(False))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.concat(F.array(F.lit(-3).cast("long")), places), lambda a, b: F.least(F.lit(3).cast("long"), a - b))
        return F.aggregate(F.slice(gaps, F.lit(1), F.size(places)), F.lit(0).cast("long"), lambda total, x: total + x)

    def flagged(ordered: Column) -> Column:
        after = F.slice(ordered, F.lit(2), F.size(ordered))
        before = F.concat(F.array(F.lit(None).cast("long")), ordered)
        equal_after = F.zip_with(ordered, after, lambda a, b: F.when(same(a, b), a))
        # zip_with pads the shorter side, so the last entry of ``before`` only meets null.
        equal_before = F.zip_with(ordered, before, lambda a, b: F.when(same(a, b), a))
        either = F.zip_with(equal_after, equal_before, lambda a, b: F.coalesce(a, b))
        return F.sort_array(F.transform(F.filter(either, lambda x: x.isNotNull()), lambda x: x.bitwiseAND(mask)))

    def equal(places: Column) -> Column:
        """The places whose whole hashes occur twice or more."""
        whole = F.sort_array(F.transform(places, lambda i: F.struct(F.get(triples, i.cast("int")).alias("hash"), i.alias("place"))))

        def beside(ordered: Column, x: Column, i: Column) -> Column:
            return F.coalesce(x["hash"] == F.get(ordered, i)["hash"], F.lit(False))

        twice = let(whole, lambda ordered: F.filter(ordered, lambda x, i: beside(ordered, x, i - 1) | beside(ordered, x, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["place"]))

    placed = F.transform(triples, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))
    counted = let(F.sort_array(placed), lambda ordered: let(equal(flagged(ordered)), covered))
    return F.when(F.size(F.array_distinct(triples)) == F.size(triples), F.lit(0).cast("long")).otherwise(counted)


def grams(docs: DataFrame, *more: str) -> DataFrame:
    """docs with words, hashes of words and the buckets of words and pairs."""
    out = docs.select("doc_id", "text", *more, words_of().alias("words"))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    buckets = F.transform(F.concat(F.col("hashes"), neighbours("hashes", 2)), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return out.withColumn("buckets", buckets)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCUMENTS) -> DataFrame:
    """doc_id of at most ``most`` trusted documents, chosen by hash."""
    good = F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("trusted")).filter("trusted")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log p_trusted - log p_raw of each bucket. BUCKETS rows at most come to the driver."""
    known = grams(docs.select("doc_id", "text")).select("doc_id", "buckets")
    # The broadcast side has TRUSTED_DOCUMENTS rows at most.
    known = known.join(F.broadcast(trusted_ids(labels)), "doc_id", "left")
    counts = known.select(F.coalesce("trusted", F.lit(False)).cast("long").alias("trusted"), F.explode_outer("buckets").alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, trusted = [1] * BUCKETS, [0] * BUCKETS
    # explode_outer spares the filter on empty arrays, which would compute the buckets twice.
    for row in (r for r in counts.collect() if r.bucket is not None):
        raw[row.bucket] += row.raw
        trusted[row.bucket] += row.trusted
    if not any(trusted):
        return [0.0] * BUCKETS
    share = [n / sum(raw) for n in raw]
    prior = PRIOR * BUCKETS
    total = sum(trusted) + prior
    return [math.log((t + prior * p) / total / p) for t, p in zip(trusted, share, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carry columns, text, the base counts, base_failed, score and kept of every row."""
    weights = ",".join(map(repr, bucket_weights(docs, labels)))
    # One literal that the optimiser folds into an array.
    weight = F.expr(f"cast(split('{weights}', ',') AS array<double>)")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = grams(docs.select("doc_id", "text", *carry), *carry).withColumn("triples", neighbours("hashes", 3)).withColumn("n_words", F.size("words").cast("long"))
    out = out.select(
        "doc_id",
        *carry,
        "text",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("triples"), F.col("n_words")).alias("n_repeat_words"),
        (F.aggregate("buckets", F.lit(0.0), lambda total, b: total + F.get(weight, b)) / F.greatest(F.size("buckets"), F.lit(1))).alias("score"),
        # Keeps the optimiser from computing all of this a second time in a filter on the verdict.
        F.monotonically_increasing_id().alias("place"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold) & (F.col("place") >= 0)).drop("place")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text")
