"""Best-two-fit packing of token sequences.

Only lengths matter to a packing, and there are at most ``size`` of them. So the tokenised pieces are
written once, their lengths are counted, and the bins are planned on that histogram: fill a bin greedily
from the longest length that fits, then put back its smallest piece if two unpacked pieces fill the
expanded gap more tightly. A planned bin is repeated as often as the counts allow, so the plan has a few
thousand rows whatever the number of documents. Each piece finds its place by its rank among the pieces
of its length, which tasks count side by side.

Defined results: null text counts as empty and packs as its end token; null doc_id is kept; every row is
packed, repeated rows once each; an empty table gives no rows; extra columns are ignored. Which of equally
long pieces takes which place follows the order in which they are read.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import materialize, table

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Characters on which all versions of the pre-tokenising classes agree; other texts take the slower library.
_PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
_encoders: dict[tuple, object] = {}


def encoder(vocabulary: str, ranks: str):
    """text -> ids as ``tokenizers`` gives them for the vocabulary file, kept for the worker.

    The same vocabulary as ranks runs several times faster, so plain texts go there. Texts with a special
    token's string, unusual characters or very long blanks go through ``tokenizers`` itself.
    """
    if (vocabulary, ranks) in _encoders:
        return _encoders[vocabulary, ranks]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    slow = Tokenizer.from_file(vocabulary)
    with open(vocabulary) as f:
        special = [x["content"] for x in json.load(f).get("added_tokens", [])]
    blanks = [x * 2000 for x in " \n\t"]

    def encode(text: str) -> list[int]:
        if not _PLAIN.fullmatch(text) or any(x in text for x in special) or any(x in text for x in blanks):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    _encoders[vocabulary, ranks] = encode
    return encode


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())]
)


def token_pieces(docs: DataFrame, size: int, vocabulary: str, ranks: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document, and the piece's place among those of its
    length in the same task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary, ranks), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                end = len(ids) % size or size if len(ids) > size else len(ids)
                start = piece = 0
                while start < len(ids):
                    n = end - start
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[start:end].tobytes()), task, seen[n]))
                    seen[n] += 1
                    start, end, piece = end, end + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, PIECES.types, strict=True)], schema=PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan bins over a histogram of lengths.

    Returns rows (length, first rank, uses in a bin, first bin, number of bins, offset): the ranks from the
    first on, ``uses`` at a time, go to consecutive bins at that offset.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    taken, plan, bins = np.zeros(size + 1, dtype=np.int64), [], 0
    lengths = np.arange(size + 1)
    while left.any():
        pool, held, gap = left.copy(), {}, size
        below = np.maximum.accumulate(np.where(pool > 0, lengths, 0))
        while gap and (longest := int(below[gap])):
            uses = min(int(pool[longest]), gap // longest)
            held[longest] = uses
            pool[longest] -= uses
            gap -= uses * longest
            below = np.maximum.accumulate(np.where(pool > 0, lengths, 0)) if pool[longest] == 0 else below
            if gap >= longest and pool[longest] == 0:
                continue
        small = min(held)
        pair = tightest_pair(pool, small, gap)
        if pair:
            held[small] -= 1
            for x in pair:
                held[x] = held.get(x, 0) + 1
        held = {x: n for x, n in held.items() if n}
        repeat = min(int(left[x]) // n for x, n in held.items())
        offset = 0
        for x in sorted(held, reverse=True):
            plan.append((x, int(taken[x]), held[x], bins, repeat, offset))
            taken[x] += held[x] * repeat
            left[x] -= held[x] * repeat
            offset += held[x] * x
        bins += repeat
    return plan


def tightest_pair(pool: np.ndarray, small: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths that together fill gap + small best, if they beat small alone."""
    room = small + gap
    if not gap or room < 2:
        return None
    lengths = np.arange(len(pool))
    below = np.maximum.accumulate(np.where(pool > 0, lengths, 0))
    first = np.flatnonzero(pool[: room] > 0)
    first = first[first > 0]
    if not len(first):
        return None
    second = below[room - first]
    twice = (second == first) & (pool[first] < 2)
    lower = below[np.maximum(first - 1, 0)]
    second = np.where(twice, lower, second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] > small else None


def pack(docs: DataFrame, size: int = SEQUENCE_TOKENS, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = materialize(token_pieces(docs, size, vocabulary, ranks), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most ``size`` rows: one a length.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places: dict[int, list[tuple]] = {}
    for length, *row in best_two_fit(histogram, size):
        places.setdefault(length, []).append(row)
    found = {x: np.array(rows, dtype=np.int64).T for x, rows in places.items()}

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("place", F.col("place") + F.col("base"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, uses, bins, _, offsets = found[int(x)]
                row = np.searchsorted(first, place[own], side="right") - 1
                nth = place[own] - first[row]
                sequence[own] = bins[row] + nth // uses[row]
                offset[own] = offsets[row] + nth % uses[row] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place").mapInArrow(put, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
