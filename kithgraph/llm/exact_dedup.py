"""Exact deduplication with Patricia-trie owners.

Texts that are identical after deleting blanks form a group. Two rounds of compressed radix tries find
each group's owner. The first round runs where the documents are read and hands every text of a task on
once, however many copies the task holds, so a group that makes up a third of all rows sends one row a
task. The second round deals the texts by (byte length, content hash), sorted, and inserts the full byte
strings again. A terminal node keeps the best row (most code points in the original text, then smallest
doc_id) and the number of rows. A trie that outgrows its byte budget spills whole subtrees: their
terminals are handed on and the branch is dropped; in the second round only keys that the sorted input
has passed are handed on, so a group never splits.

Defined results: null text counts as empty; null doc_id loses every tie; repeated rows count as often as
they occur and one of them stays; of rows with one doc_id the one with the most code points stays; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import BLANK_CHARS, materialize, table

TRIE_BYTES = 24 << 20
#: A group with more than this part of all rows is large.
LARGE_SHARE = 4096


class Node:
    """A node of a compressed radix trie; ``label`` is the byte string on the edge to it."""

    __slots__ = ("best", "count", "edges", "label")

    def __init__(self, label: bytes) -> None:
        self.label, self.edges, self.best, self.count = label, {}, None, 0


class Trie:
    """Byte strings with, at each terminal node, the best (order) value and the number of rows."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def insert(self, key: bytes, order: tuple, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.edges.get(key[at])
            if child is None:
                child = node.edges[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + 200
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = shared_prefix(label, key, at)
            upper = Node(label[:same])
            child.label = label[same:]
            upper.edges[child.label[0]] = child
            node.edges[key[at]] = upper
            self.bytes += 200
            node, at = upper, at + same
        node.count += count
        if node.best is None or order < node.best:
            node.best = order

    def terminals(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple, int]]:
        todo = [(top or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            text = prefix + node.label
            if node.count:
                yield text, node.best, node.count
            todo += [(child, text) for child in node.edges.values()]

    def spill(self) -> Iterator[tuple[bytes, tuple, int]]:
        """Hand on the subtrees below the root, one at a time, and drop them."""
        if self.root.count:
            yield b"", self.root.best, self.root.count
        for byte in list(self.root.edges):
            yield from self.terminals(self.root.edges.pop(byte))
        self.root, self.bytes = Node(b""), 0


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def order_of(points: int, doc_id: int | None) -> tuple:
    return (-points, doc_id is None, doc_id or 0)


OWNERS = pa.schema([("body", pa.binary()), ("points", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def rows_of(found: list[tuple[bytes, tuple, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in found], pa.binary()),
            pa.array([-x[1][0] for x in found], pa.int64()),
            pa.array([None if x[1][1] else x[1][2] for x in found], pa.int64()),
            pa.array([x[2] for x in found], pa.int64()),
        ],
        schema=OWNERS,
    )


def batched(found: Iterator[tuple[bytes, tuple, int]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for x in found:
        out.append(x)
        size += len(x[0]) + 64
        if size > limit:
            yield rows_of(out)
            out, size = [], 0
    if out:
        yield rows_of(out)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries over the rows of one task, in any order; spilled texts may be handed on more than once."""
    trie = Trie()
    for batch in batches:
        bodies, points, ids, counts = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            trie.insert(bodies[i].as_py(), order_of(points[i].as_py(), ids[i].as_py()), counts[i].as_py())
            if trie.bytes > TRIE_BYTES:
                yield from batched(trie.spill())
    yield from batched(trie.spill())


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries over rows sorted by (length, hash): equal texts stand together, so spills wait for a new key."""
    trie, last = Trie(), None
    for batch in batches:
        bodies, points, ids, counts = (batch.column(i) for i in range(4))
        hashes = batch.column(4).to_pylist()
        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            if trie.bytes > TRIE_BYTES and (len(body), hashes[i]) != last:
                yield from batched(trie.spill())
            last = len(body), hashes[i]
            trie.insert(body, order_of(points[i].as_py(), ids[i].as_py()), counts[i].as_py())
    yield from batched(trie.spill())


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANK_CHARS, "")


def owners(docs: DataFrame) -> DataFrame:
    """text_sha256, keep_id, most_points (code points of the row that stays), group_size: one row per group of equal normalised texts."""
    schema = "body binary, points long, keep_id long, group_size long"
    read = docs.select(
        normalised().cast("binary").alias("body"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    once = read.mapInArrow(gather, schema)
    dealt = (
        once.withColumn("length", F.octet_length("body"))
        .withColumn("hash", F.xxhash64("body"))
        .repartition("length", "hash")
        .sortWithinPartitions("length", "hash")
        .select("body", "points", "keep_id", "group_size", "hash")
    )
    return dealt.mapInArrow(settle, schema).select(F.sha2("body", 256).alias("text_sha256"), "keep_id", F.col("points").alias("most_points"), "group_size")


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns, text_sha256 and code points of every row."""
    points = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", *more, F.sha2(normalised().cast("binary"), 256).alias("text_sha256"), points.alias("points"))


#: Whether a row is the one that stays, or repeats it.
STAYS = "points = most_points AND cast(doc_id AS long) <=> keep_id"


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; one row of a group is kept.

    Groups of more than one row in ``LARGE_SHARE`` are at most that many and meet their rows by a broadcast, so no text's
    rows gather in one task. Rows are written with a number first: of repeated rows the one with the smallest stays.
    """
    rows = materialize(text_rows(docs).withColumn("row", F.monotonically_increasing_id()), "texts")
    groups = materialize(owners(docs), "owners")
    large = groups.filter(F.col("group_size") > rows.count() / LARGE_SHARE)
    columns = ["doc_id", "keep_id", "group_size", "text_sha256", "row"]
    # A list of 4096 rows at most.
    near = rows.join(F.broadcast(large), "text_sha256").withColumn("best", F.expr(STAYS)).select(*columns, "best")
    rest = rows.join(F.broadcast(large.select("text_sha256")), "text_sha256", "left_anti")
    small = groups.filter(F.col("group_size") <= rows.count() / LARGE_SHARE)
    found = near.unionByName(rest.join(small, "text_sha256").withColumn("best", F.expr(STAYS)).select(*columns, "best"))
    again = found.filter("best").groupBy("text_sha256").agg(F.count("*").alias("times"), F.min("row").alias("first")).filter("times > 1")
    kept = F.col("best") & (F.col("first").isNull() | (F.col("first") == F.col("row")))
    # Rows that can't stay match nothing and are dealt by their own number, not by their group.
    asked = found.withColumn("asked", F.when(F.col("best"), F.col("text_sha256")).otherwise(F.col("row").cast("string")))
    return asked.join(again.select(F.col("text_sha256").alias("asked"), "first"), "asked", "left").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doc_id and text_sha256 of the rows that stay, and rows that repeat them; rows meet their owner by id and text."""
    groups = owners(docs).withColumnRenamed("text_sha256", "own_sha256")
    return text_rows(docs, *columns).join(groups, F.expr(f"text_sha256 = own_sha256 AND {STAYS}"), "left_semi").drop("points")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS group_size, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n
  FROM d WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""
