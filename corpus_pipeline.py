"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept.

Stages read the columns of ``documents`` and ignore others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import materialize, table
from kithgraph.llm.exact_dedup import kept_rows
from kithgraph.llm.jaccard_join import jaccard_components
from kithgraph.llm.packing import pack
from kithgraph.llm.quality_rules import judge
from kithgraph.llm.substring_dedup import remove_passages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source", "n_chars")


def one_of_each(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys: the longest text, then the greatest row. Tasks combine before they send."""
    order = F.struct(F.coalesce(F.length("text"), F.lit(-1)).alias("points"), *COLUMNS)
    return docs.groupBy(*keys).agg(F.max(order).alias("row")).select(*(F.col(f"row.{name}").alias(name) for name in COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows stay or go alike."""
    return judge(docs, table(spark, sf_dir, "labels"), carry=CARRIED).filter("kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each group of equal texts; one row where it is repeated. Null and empty texts are one group."""
    return one_of_each(kept_rows(docs, "text", *CARRIED), "doc_id", "text_sha256")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id, and one row where it is repeated.

    Documents without words are linked with nothing and all stay, repeated rows too.
    """
    found = jaccard_components(docs, labelled=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key"))
    stays = found.filter("label IS NOT NULL").groupBy("label").agg(first.alias("o")).select(F.col("o.doc_id").alias("id"), F.col("o.text_key").alias("key"))
    alone = found.filter("label IS NULL").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    same = (F.col("text_key") == F.col("key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("id"))
    return one_of_each(rows.join(stays, same, "left_semi"), "doc_id", "text_key").unionByName(rows.join(alone, same, "left_semi").select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with repeated passages keep their other words, joined by one space.

    Null, empty and short texts stay as they are. Repeated rows of long texts remove each other's words, as any
    two documents do; the stages before leave none.
    """
    found = remove_passages(docs, carry=CARRIED)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = docs.schema["n_chars"].dataType
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast(size)).otherwise(F.col("n_chars")).alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in token sequences; a null or empty text packs as its end token."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", best_fit_packing),
]

#: The automata, tries and packing have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
