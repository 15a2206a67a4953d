"""Windows of units (words or bytes) routed by their anchor.

Every window of ``width`` units holds ``width - gram + 1`` grams; the smallest gram hash is its anchor. Equal
windows have equal anchors, wherever they stand, so whatever recurs meets under one anchor. A run of
neighbouring windows with one anchor is a segment: a row (anchor, content, doc_id, text_key, start, windows),
one for about half a window's length of text. Anchors that occur once are dropped before any text moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm import textscan as ts
from kithgraph.llm.common import discard, document_rows, materialize, same_row

#: Longer runs of one anchor (periodic text) are cut; routing needs only the anchor.
LONGEST_RUN = 256

SEGMENT_SCHEMA = "anchor long, content long, doc_id long, text_key long, start long, windows int, twice boolean"


def unit_sums(data: np.ndarray, offsets: np.ndarray, by_words: bool) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """Prefix sums of unit values, unit offsets by row, and the words' byte spans."""
    if not by_words:
        return ts.byte_sums(data), offsets, None
    starts, ends, rows = ts.word_spans(data, offsets)
    values = ts.span_hashes(ts.byte_sums(data), starts, ends)
    return ts.prefix_sums(values), np.searchsorted(rows, np.arange(len(offsets))), (starts, ends)


def runs(sums: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, first unit, number of windows, row, and whether the anchor stands at two places, of each segment."""
    n = len(sums) - 1
    none = tuple(np.zeros(0, x) for x in (np.uint64, np.int64, np.int64, np.int64, bool))
    if n < width:
        return none
    at = np.arange(n - gram + 1)
    grams = ts.span_hashes(sums, at, at + gram)
    anchors = ts.sliding_min(grams, width - gram + 1)
    ok = np.zeros(n + 1, dtype=bool)
    for first, last in zip(offsets[:-1], offsets[1:], strict=True):
        if last - first >= width:
            ok[first : last - width + 1] = True
    ok = ok[: len(anchors)]
    new = np.ones(len(anchors), dtype=bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none
    edge = np.flatnonzero(new | ~ok)
    after = np.append(edge, len(anchors))[np.searchsorted(edge, first, side="right")]
    length = after - first
    if (length > LONGEST_RUN).any():
        pieces = -(-length // LONGEST_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = np.repeat(first, pieces) + nth * LONGEST_RUN
        length = np.minimum(LONGEST_RUN, np.repeat(first + length, pieces) - cut)
        first = cut
    anchor = anchors[first]
    return anchor, first, length, np.searchsorted(offsets, first, side="right") - 1, stands_twice(grams, anchor, first, length, width - gram + 1)


def stands_twice(grams: np.ndarray, anchor: np.ndarray, first: np.ndarray, length: np.ndarray, per_window: int) -> np.ndarray:
    """Whether the first anchor gram of the first window is another than the last of the last window."""
    within, out = np.arange(per_window), np.zeros(len(first), dtype=bool)
    for low in range(0, len(first), 4096):
        part = slice(low, low + 4096)
        begin, end = first[part, None], (first + length - 1)[part, None]
        left = (grams[begin + within] == anchor[part, None]).argmax(axis=1) + begin[:, 0]
        right = per_window - 1 - (grams[end + within[::-1]] == anchor[part, None]).argmax(axis=1) + end[:, 0]
        out[part] = left != right
    return out


def find_segments(docs: DataFrame, width: int, gram: int, by_words: bool) -> DataFrame:
    """All segments of all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(1))
            for low, high in ts.slices(offsets):
                part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                sums, units, _ = unit_sums(part, own, by_words)
                anchors, first, length, rows, twice = runs(sums, units, width, gram)
                content = ts.span_hashes(sums, first, first + length + width - 1) if len(first) else first
                take = pa.array(rows + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        batch.column(0).take(take),
                        batch.column(2).take(take),
                        pa.array(first - units[rows]),
                        pa.array(length.astype(np.int32)),
                        pa.array(twice),
                    ],
                    names=["anchor", "content", "doc_id", "text_key", "start", "windows", "twice"],
                )

    return docs.select("doc_id", "text", "text_key").mapInArrow(scan, SEGMENT_SCHEMA)


def recurring_segments(docs: DataFrame, width: int, gram: int, by_words: bool) -> DataFrame:
    """The segments whose anchor occurs more than once, in different segments or within one."""
    found = materialize(find_segments(docs, width, gram, by_words), "segments")
    often = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    often = often.filter((F.col("n") > 1) | F.col("twice")).select("anchor")
    recurring = materialize(found.drop("twice").join(often, "anchor"), "recurring")
    discard(found)
    return recurring


def distinct_segments(recurring: DataFrame) -> DataFrame:
    """One row for equal segments: how often it occurs and where to read it."""
    return recurring.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("at")
    )


CUT_SCHEMA = "anchor long, content long, windows int, copies long, body string"


def segment_texts(docs: DataFrame, distinct: DataFrame, width: int, by_words: bool) -> DataFrame:
    """distinct, with the text of each segment (its words joined by one space, or its bytes)."""
    wanted = distinct.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(
        F.collect_list(F.struct("anchor", "content", F.col("at.windows").alias("windows"), "copies", F.col("at.start").alias("start"))).alias("cuts")
    )
    # Repeated rows hold the same text: one of them is enough.
    joined = docs.join(wanted, same_row(docs, wanted)).select(docs.doc_id, docs.text_key, docs.text, "cuts")
    kind = pa.string() if by_words else pa.binary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(0))
            cuts = batch.column(1)
            bounds = np.asarray(cuts.offsets) - cuts.offsets[0].as_py()
            flat = cuts.flatten()
            fields = [np.asarray(flat.field(name)) for name in ("anchor", "content", "windows", "copies", "start")]
            out: list[list] = [[] for _ in range(5)]
            size = 0
            for row in range(batch.num_rows):
                own = slice(bounds[row], bounds[row + 1])
                anchor, content, windows, copies, start = (x[own] for x in fields)
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                if by_words:
                    words = text.split()
                    bodies = [b" ".join(words[s : s + w + width - 1]) for s, w in zip(start.tolist(), windows.tolist(), strict=True)]
                else:
                    bodies = [text[s : s + w + width - 1] for s, w in zip(start.tolist(), windows.tolist(), strict=True)]
                for column, values in zip(out, (anchor, content, windows, copies, bodies), strict=True):
                    column.extend(values)
                size += sum(map(len, bodies))
                if size > 4 << 20 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()).cast(kind)],
                        names=["anchor", "content", "windows", "copies", "body"],
                    )
                    out, size = [[] for _ in range(5)], 0

    schema = CUT_SCHEMA if by_words else CUT_SCHEMA.replace("body string", "body binary")
    return joined.select("text", "cuts").mapInArrow(cut, schema)


#: A window that stands in more than one in so many rows of crowded windows meets its count by a broadcast.
CROWD_SHARE = 4096


def crowded_spans(texts: DataFrame, width: int, by_words: bool) -> DataFrame:
    """anchor, content, span of the repeated runs in segments that stay crowded in every order.

    Each window is a row, told apart by its hash and counted by partial sums; no group holds an anchor's segments.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(3))
            for low, high in ts.slices(offsets):
                sums, units, _ = unit_sums(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], by_words)
                windows = np.asarray(batch.column(2))[low:high].astype(np.int64)
                row = np.repeat(np.arange(high - low), windows)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                first, take = units[row] + nth, pa.array(row + low)
                hashes = ts.span_hashes(sums, first, first + width)
                columns = [batch.column(i).take(take) for i in (0, 1, 4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(nth), pa.array(hashes.view(np.int64))], names=["anchor", "content", "copies", "nth", "window"])

    found = texts.select("anchor", "content", "windows", "body", "copies").mapInArrow(scan, "anchor long, content long, copies long, nth long, window long")
    # Repeated rows hand their segments on more than once.
    windows = materialize(found.dropDuplicates(["anchor", "content", "nth"]), "crowded")
    counted = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    often = materialize(counted.filter("n > 1").select("anchor", "window", "rows"), "crowded-often")
    limit = max(1, windows.count() // CROWD_SHARE)
    key = ["anchor", "window"]
    most = F.broadcast(often.filter(F.col("rows") > limit).select(key))
    # The most frequent windows, CROWD_SHARE at most, move no rows to one task.
    hit = windows.join(most, key, "left_semi").unionByName(windows.join(most, key, "left_anti").join(often.filter(F.col("rows") <= limit).select(key), key, "left_semi"))
    run = F.col("nth") - F.row_number().over(W.partitionBy("anchor", "content").orderBy("nth"))
    ends = hit.withColumn("run", run).groupBy("anchor", "content", "run").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    return ends.select("anchor", "content", (F.shiftleft("first", 32) + F.col("last") + width).alias("span"))


#: Times that the segments of an anchor too large for one bucket are cut anew by other anchors.
LEVELS = 4


def salted(grams: np.ndarray, level: int) -> np.ndarray:
    """Gram hashes in another order for each level."""
    return ts.mix(grams ^ np.uint64(ts.MULTIPLIER * (2 * level + 1) % (1 << 64)))


def finer_segments(texts: DataFrame, level: int, width: int, gram: int, by_words: bool) -> DataFrame:
    """anchor, content, at, finer, part, windows, copies, body: the segments cut where their windows' anchor in another order changes.

    Equal windows have equal anchors in every order; windows that only share a common gram seldom do.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(4))
            kind = batch.schema.field(4).type
            for low, high in ts.slices(offsets):
                part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                sums, units, words = unit_sums(part, own, by_words)
                at = np.arange(len(sums) - gram)
                anchors = ts.sliding_min(salted(ts.span_hashes(sums, at, at + gram), level), width - gram + 1)
                windows = np.asarray(batch.column(2))[low:high].astype(np.int64)
                row = np.repeat(np.arange(high - low), windows)
                place = units[row] + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                new = np.append(True, (row[1:] != row[:-1]) | (anchors[place[1:]] != anchors[place[:-1]]))
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(row)))
                first, row = place[begin], row[begin]
                last = first + count + width - 1
                content = ts.span_hashes(sums, first, last)
                before = np.asarray(batch.column(0))[low:high].view(np.uint64)[row]
                finer = ts.mix(before ^ ts.mix(anchors[first]))
                # Words of a segment stand one blank apart.
                starts, ends = (words[0][first], words[1][last - 1]) if by_words else (first, last)
                bodies = [part[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                take = pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(first - units[row]), pa.array(finer.view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array(count.astype(np.int32)), batch.column(3).take(take), pa.array(bodies, pa.binary()).cast(kind),
                    ],
                    names=["anchor", "content", "at", "finer", "part", "windows", "copies", "body"],
                )

    body = texts.schema["body"].dataType.simpleString()
    return texts.select("anchor", "content", "windows", "copies", "body").mapInArrow(scan, f"anchor long, content long, at long, finer long, part long, windows int, copies long, body {body}")


def located(texts: DataFrame, width: int, gram: int, by_words: bool, locate: Callable[[dict], tuple], bucket_bytes: int, level: int = 0) -> DataFrame:
    """anchor, content, span of the repeated runs of segments (anchor, content, windows, copies, body).

    Anchors are dealt to buckets of about ``bucket_bytes`` of text. Segments of an anchor with more than that are cut by
    anchors of another order and go through the same once more; windows that are still crowded after ``LEVELS`` orders
    are counted one by one.
    """
    total = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def shard(group: pa.Table) -> pa.Table:
        # Repeated rows hand their segments on more than once.
        key = pa.table({"a": group.column("anchor"), "b": group.column("content"), "i": np.arange(group.num_rows)})
        once = key.group_by(["a", "b"]).aggregate([("i", "min")]).column("i_min")
        columns = {name: group.column(name).take(once).combine_chunks() for name in group.column_names}
        segment, first, count = locate(columns)
        take = pa.array(segment)
        return pa.table(
            {
                "anchor": columns["anchor"].take(take),
                "content": columns["content"].take(take),
                "span": pa.array((np.asarray(first, np.int64) << 32) + first + count + width - 1),
            }
        )

    # One anchor for each bucket_bytes of text at most.
    crowded = materialize(texts.groupBy("anchor").agg(F.sum(F.octet_length("body")).alias("bytes")).filter(F.col("bytes") > bucket_bytes).select("anchor"), "crowded-anchors")
    split = not crowded.isEmpty()
    alone = texts.join(F.broadcast(crowded), "anchor", "left_anti") if split else texts
    found = alone.withColumn("bucket", F.pmod("anchor", F.lit(buckets))).groupBy("bucket").applyInArrow(shard, "anchor long, content long, span long")
    if not split:
        return found
    rest = texts.join(F.broadcast(crowded), "anchor", "left_semi")
    if level == LEVELS:
        return found.unionByName(crowded_spans(rest, width, by_words))
    cut = materialize(finer_segments(rest.dropDuplicates(["anchor", "content"]), level + 1, width, gram, by_words), "finer")
    # Copies of a part are one segment, met by partial sums.
    parts = cut.groupBy(F.col("finer").alias("anchor"), F.col("part").alias("content")).agg(F.min("windows").alias("windows"), F.sum("copies").alias("copies"), F.min("body").alias("body"))
    inner = located(materialize(parts, "finer-texts"), width, gram, by_words, locate, bucket_bytes, level + 1)
    inner = inner.select(F.col("anchor").alias("finer"), F.col("content").alias("part"), "span")
    move = F.col("at") * F.lit((1 << 32) + 1)
    return found.unionByName(cut.select("anchor", "content", "at", "finer", "part").join(inner, ["finer", "part"]).select("anchor", "content", (F.col("span") + move).alias("span")))


def repeated_ranges(
    docs: DataFrame, width: int, gram: int, by_words: bool, locate: Callable[[dict], tuple], bucket_bytes: int
) -> DataFrame:
    """doc_id, text_key, spans: unit ranges [first, last) covered by a window that occurs more than once.

    ``locate`` works on the distinct segments of a bucket of anchors and returns, for each repeated run,
    (segment number, first window, number of windows).
    """
    recurring = recurring_segments(docs, width, gram, by_words)
    texts = materialize(segment_texts(docs, distinct_segments(recurring), width, by_words), "texts")
    hits = materialize(
        located(texts, width, gram, by_words, locate, bucket_bytes).groupBy("anchor", "content")
        .agg(F.collect_set("span").alias("found")),
        "hits",
    )
    discard(texts)
    # A span holds both ends, first in the upper half; shifting it moves both.
    move = F.col("start") * F.lit((1 << 32) + 1)
    return (
        recurring.join(hits, ["anchor", "content"])
        .select("doc_id", "text_key", F.transform("found", lambda x: x + move).alias("found"))
        .groupBy("doc_id", "text_key")
        .agg(F.flatten(F.collect_list("found")).alias("spans"))
    )


def rows_with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of docs with its spans (null: none)."""
    return docs.join(spans, same_row(docs, spans), "left").select(docs["*"], "spans")


def merged(found: pa.ListScalar) -> np.ndarray:
    """Sorted, disjoint, non-touching ranges of a row's spans, as an (n, 2) array; null: none."""
    if not found.is_valid:
        return np.zeros((0, 2), np.int64)
    packed = np.asarray(found.values)
    spans = np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def base_rows(docs: DataFrame) -> DataFrame:
    return document_rows(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
