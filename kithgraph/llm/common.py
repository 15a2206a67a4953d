"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this class; the same class for Spark and DuckDB.
BLANKS = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; only a session without that setting (tests in local mode)
    gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_kithgraph_shared_dir", None) or tempfile.mkdtemp(prefix="kithgraph-")
        spark._kithgraph_shared_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def document_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns, with ``text_key``.

    (doc_id, text_key) identifies a row's content: equal for repeated rows, different for rows that
    share a doc_id but not the text. Null doc_id is a value like any other (joins are null-safe).
    """
    return docs.select("doc_id", "text", *more, F.xxhash64("text").alias("text_key"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a.text_key == b.text_key) & a.doc_id.eqNullSafe(b.doc_id)
