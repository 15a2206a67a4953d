"""Removal of word passages that recur, found by repeated-phrase automata.

A window of ``width`` words is repeated if its word sequence also starts anywhere else. Windows are routed
by their anchors (see ``segments``), so each shard gets all text that can hold its phrases. In a shard, counts
of windows choose the phrases: windows that always follow each other are one phrase, of which a single copy is
compiled into the shard's Aho-Corasick automaton over word codes. All text of the shard is streamed through
it. The automaton alone finds the places and, as it compares word by word, confirms by their number that a
phrase recurs. All words of an occurrence go. Anchors with more text than a shard holds are split by window,
which then is told apart by its hash (see ``crowded_spans``).

Defined results: null text has no words; a document of fewer words than a window keeps them all; repeated
rows are documents of their own, so long ones remove each other; null doc_id is kept; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import segments as sg
from kithgraph.llm import textscan as ts
from kithgraph.llm.common import table

WIDTH = 35
GRAM = 8
BUCKET_BYTES = 2 << 20
#: Code points that a word may stand for, without surrogates.
_CODES, _GAP, _SURROGATES = 0x10F7FF, 0x800, 0xD7FF


def coded(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One code point a word over all bodies, and the bodies' offsets."""
    codes: dict[str, int] = {}
    ids = [[codes.setdefault(w, len(codes)) for w in body.split(" ")] for body in bodies]
    flat = np.fromiter((x for own in ids for x in own), dtype=np.uint32, count=sum(map(len, ids)))
    flat = flat % np.uint32(_CODES) + np.uint32(1)
    flat[flat > _SURROGATES] += np.uint32(_GAP)
    return flat, np.cumsum([0, *map(len, ids)])


def phrases(codes: np.ndarray, offsets: np.ndarray, copies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First code and number of windows of one copy of each phrase that may recur.

    Neighbouring windows belong to one phrase if neither occurs without the other, so whoever holds one of a
    phrase's windows holds the whole phrase.
    """
    sums = ts.prefix_sums(ts.mix(codes.astype(np.uint64)))
    lengths = np.maximum(offsets[1:] - offsets[:-1] - width + 1, 0)
    segment = np.repeat(np.arange(len(lengths)), lengths)
    at = offsets[segment] + np.arange(len(segment)) - (np.cumsum(lengths) - lengths)[segment]
    _, first, which = np.unique(ts.span_hashes(sums, at, at + width), return_index=True, return_inverse=True)
    times = np.bincount(which, weights=copies[segment])
    chosen = np.zeros(len(at), dtype=bool)
    chosen[first[times > 1]] = True
    # How often each two windows stand side by side.
    beside = np.flatnonzero(segment[1:] == segment[:-1])
    pair, kind = np.unique(which[beside] * len(times) + which[beside + 1], return_inverse=True)
    both = np.zeros(len(at))
    both[beside + 1] = np.bincount(kind, weights=copies[segment[beside]], minlength=len(pair))[kind]
    goes_on = np.zeros(len(at), dtype=bool)
    goes_on[1:] = chosen[1:] & chosen[:-1] & (both[1:] == times[which[1:]]) & (both[1:] == times[which[:-1]])
    begins = np.flatnonzero(chosen & ~goes_on)
    return at[begins], np.bincount(np.cumsum(chosen & ~goes_on)[chosen] - 1, minlength=len(begins)).astype(np.int64)


def locate(columns: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, offsets = coded(columns["body"].to_pylist())
    text, copies = codes.astype("<u4").tobytes().decode("utf-32-le"), np.asarray(columns["copies"])
    first, count = phrases(codes, offsets, copies, width)
    automaton = ahocorasick.Automaton()
    for i, (low, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        automaton.add_word(text[low : low + n + width - 1], i)
    found: list[tuple[int, int, int]] = []
    if len(automaton):
        automaton.make_automaton()
        for segment, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            found += [(segment, end - low, i) for end, i in automaton.iter(text, low, high)]
    segment, end, phrase = np.array(found, dtype=np.int64).reshape(-1, 3).T
    recurs = np.bincount(phrase, weights=copies[segment], minlength=len(first))[phrase] > 1
    segment, end, n = segment[recurs], end[recurs], count[phrase[recurs]]
    return segment, end - n - width + 2, n


def remove_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, text, n_words, n_removed, kept (the words left, joined by one space)."""
    rows = sg.base_rows(docs)
    spans = sg.repeated_ranges(rows, width, gram, True, lambda c: locate(c, width), BUCKET_BYTES)
    carried = docs.select("doc_id", *carry, "text", F.xxhash64("text").alias("text_key"))
    joined = sg.rows_with_spans(carried.withColumn("doc_id", F.col("doc_id").cast("long")), spans).drop("text_key")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if found.is_valid:
                    cut = sg.merged(found)
                    edges = [0, *cut.ravel().tolist(), len(words)]
                    words = [w for low, high in zip(edges[::2], edges[1::2], strict=True) for w in words[low:high]]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            more = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*batch.schema.names[:-1], "n_words", "n_removed", "kept"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("spans").schema] + ["n_words long", "n_removed long", "kept string"])
    return joined.mapInArrow(keep, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35
), h AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s
), c AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), x AS (SELECT DISTINCT r, p + unnest(range(0, 35)) AS p FROM c
), k AS (SELECT r, list(p) AS gone FROM x GROUP BY r
), l AS (SELECT doc_id, r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), o AS (SELECT l.r, string_agg(word, ' ' ORDER BY l.p) AS kept FROM l ANTI JOIN x ON l.r = x.r AND l.p = x.p GROUP BY l.r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN o USING (r)
"""
