"""Removal of byte strings that recur, found by suffix arrays.

A window of ``width`` bytes is repeated if its string also starts anywhere else. Windows are routed by their
anchors (see ``segments``). For the distinct segments of a bucket of anchors a suffix array is built in two
stages: the suffixes that are smaller than their successors are sorted directly, the others are induced by
scanning the buckets of first bytes from the smallest up. Common prefixes of neighbours, as far as a window,
then show which windows recur.

Defined results: null text is no bytes; a document shorter than a window keeps all; repeated rows are
documents of their own, so long ones remove each other; null doc_id is kept; an empty table gives no rows;
extra columns are ignored. What is left need not be valid UTF-8, so it is returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import segments as sg
from kithgraph.llm import textscan as ts
from kithgraph.llm.common import table

WIDTH = 200
GRAM = 50
BUCKET_BYTES = 2 << 20


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; text ends with its only kind of terminator, 0."""
    n = len(text)
    after = np.append(text[1:], -1)
    differs = (text != after) | (text == 0)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return (text[at] < after[at]) | (text[at] == 0)


def suffix_array(body: bytes, offsets: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Window starts of all segments, sorted by their first ``width`` bytes.

    Segment i holds body[offsets[i] : offsets[i + 1]], its last byte being a terminator; windows[i] of its
    suffixes are window starts.
    """
    raw = np.frombuffer(body, dtype=np.uint8)
    text = raw.astype(np.int16) + 1
    text[offsets[1:] - 1] = 0
    small = smaller_than_next(text)
    places = np.arange(len(text))
    # Induction starts at the first small suffix at or after the last window start.
    next_small = np.minimum.accumulate(np.where(small, places, len(text))[::-1])[::-1]
    limit = np.repeat(next_small[offsets[:-1] + windows - 1], np.diff(offsets))
    needed = places <= limit
    ends = np.repeat(offsets[1:] - 1, np.diff(offsets))
    direct = np.flatnonzero(small & needed)
    keys = [body[p : min(p + width, end)] for p, end in zip(direct.tolist(), ends[direct].tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    # A terminator's own key is empty, so it sorts first like its character, 0.
    bounds = np.searchsorted(text[direct], np.arange(258))

    starts = np.zeros(len(text), dtype=bool)
    starts[offsets[:-1]] = True
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    order: list[np.ndarray] = []

    def induce(found: np.ndarray, char: int) -> np.ndarray:
        """Deal the larger predecessors to the buckets of their first bytes; return those of this bucket."""
        before = found[~starts[found]] - 1
        before = before[~small[before] & needed[before]]
        chars = text[before]
        by_char = np.argsort(chars, kind="stable")
        before, chars = before[by_char], chars[by_char]
        own = before[:0]
        if not len(chars):
            return own
        edges = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        for low, high in zip(edges, [*edges[1:], len(chars)], strict=True):
            if chars[low] == char:
                own = before[low:high]
            else:
                waiting[chars[low]].append(before[low:high])
        return own

    for char in range(257):
        queue = np.concatenate(waiting[char]) if waiting[char] else direct[:0]
        waiting[char] = []
        while len(queue):
            order.append(queue)
            queue = induce(queue, char)
        own = direct[bounds[char] : bounds[char + 1]]
        if len(own):
            order.append(own)
            induce(own, char)
    found = np.concatenate(order)
    is_window = places - np.repeat(offsets[:-1], np.diff(offsets)) < np.repeat(windows, np.diff(offsets))
    return found[is_window[found]]


def common_prefixes(body: bytes, order: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of neighbours in the array, up to ``width``."""
    raw = np.frombuffer(body + bytes(8), dtype=np.uint8)
    eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    out = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    active = np.arange(len(out))
    while len(active):
        a, b = order[active] + out[active], order[active + 1] + out[active]
        differ = eight[a] ^ eight[b]
        # The lowest differing byte of little-endian words is the first one.
        same = np.where(differ == 0, 8, np.log2((differ & (~differ + np.uint64(1))).astype(np.float64) + (differ == 0)).astype(np.int64) // 8)
        out[active] = np.minimum(out[active] + same, width)
        active = active[(same == 8) & (out[active] < width)]
    return out


def locate(columns: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bodies, copies = columns["body"].to_pylist(), np.asarray(columns["copies"])
    windows = np.asarray(columns["windows"]).astype(np.int64)
    body = b"\0".join([*bodies, b""])
    offsets = np.cumsum([0, *(len(x) + 1 for x in bodies)])
    order = suffix_array(body, offsets, windows, width)
    segment = np.searchsorted(offsets, order, side="right") - 1
    group = np.cumsum(np.append(0, common_prefixes(body, order, width) < width))
    often = np.bincount(group, weights=copies[segment])[group] > 1
    at = np.sort(order[often])
    if not len(at):
        return at, at, at
    segment = np.searchsorted(offsets, at, side="right") - 1
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])))
    return segment[first], at[first] - offsets[segment[first]], np.diff(np.append(first, len(at)))


def remove_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every row."""
    rows = sg.base_rows(docs)
    spans = sg.repeated_ranges(rows, width, gram, False, lambda c: locate(c, width), BUCKET_BYTES)
    joined = sg.rows_with_spans(rows, spans).select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(1))
            removed, runs, kept = [], [], []
            for row, found in enumerate(batch.column(2)):
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                cut = sg.merged(found)
                edges = [0, *cut.ravel().tolist(), len(text)]
                kept.append(b"".join(text[low:high] for low, high in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(cut))
            more = [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), y AS (SELECT r, q, substr(x, 2 * q + 1, 2398) AS y FROM (SELECT r, x, unnest(range(0, len(x) // 2, 1000)) AS q FROM d)
), h AS (SELECT r, q + p AS p, md5(substr(y, 2 * p + 1, 400)) AS h FROM (SELECT r, q, y, unnest(range(0, least(1000, len(y) // 2 - 199))) AS p FROM y WHERE len(y) >= 400)
), c AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), e AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM c
), g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS span FROM e
), s AS (SELECT r, span, min(p) AS low, max(p) + 200 AS high FROM g GROUP BY r, span
), t AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM s
), k AS (SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(x), 2 * max(high) + 1) AS kept
  FROM t JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
