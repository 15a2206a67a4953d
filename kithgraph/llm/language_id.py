"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, in order. A document's most frequent
n-grams, ranked the same way, are compared to each profile by out-of-place distance: the sum over its n-grams
of how far their rank is from the profile's, or a full profile length if the profile lacks them. The nearest
profile wins, ties by name.

n-grams are one to three letters, with a blank before and after each run of letters. Letters count in lower
case and are told apart by their code point modulo 1021, so an n-gram is one 32-bit number and a text's counts
are one sort. Training counts cover all texts outside the held-out third that carry a language and are
pre-aggregated where they are read. Profiles are a few hundred rows a language, whatever the corpus.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts if nothing
can be learned; null doc_id counts as training, as its text has no checksum; repeated rows are judged alike
and count as often as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm import textscan as ts
from kithgraph.llm.common import table

PROFILE = 300
UNKNOWN = "und"
_classes: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """1 to 1021 for each code point that is a letter, else 0; kept for the worker."""
    if not _classes:
        found = np.zeros(0x110000, dtype=np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                found[point] = ord(char.lower()[0]) % 1021 + 1
        _classes.append(found)
    return _classes[0]


def slice_grams(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For slices of rows: the first row, and each row's n-grams, sorted."""
    data, offsets = ts.string_buffers(column)
    for low, high in ts.slices(offsets):
        part = data[offsets[low] : offsets[high]]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))[offsets[low : high + 1] - offsets[low]]
        # A blank before each row and at the end.
        a = np.insert(letter_classes()[points], chars, np.uint32(0))
        before = chars + np.arange(len(chars))
        after, further = np.append(a[1:], np.uint32(0)), np.append(a[2:], np.zeros(min(2, len(a)), np.uint32))
        one = np.where(a > 0, a | np.uint32(1 << 30), np.uint32(0))
        two = np.where((a > 0) | (after > 0), (a << np.uint32(10)) | after | np.uint32(2 << 30), np.uint32(0))
        three = np.where(after > 0, (a << np.uint32(20)) | (after << np.uint32(10)) | further | np.uint32(3 << 30), np.uint32(0))
        rows = []
        for first, last in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            grams = np.concatenate([one[first:last], two[first:last], three[first : last - 1]])
            grams.sort()
            rows.append(grams[np.searchsorted(grams, 1) :])
        yield low, rows


def tally(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and counts of a sorted array."""
    edges = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[edges], np.diff(np.append(edges, len(grams)))


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    key = ((np.uint64(0xFFFFFFFF) - counts.astype(np.uint64)) << np.uint64(32)) | grams.astype(np.uint64)
    if len(key) > size:
        key = np.partition(key, size - 1)[:size]
    key.sort()
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n of docs (text, lang), counted batch by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            langs = batch.column(1).to_pylist()
            for low, rows in slice_grams(batch.column(0)):
                own: dict[str, list[np.ndarray]] = {}
                for lang, grams in zip(langs[low:], rows, strict=False):
                    own.setdefault(lang, []).append(grams)
                for lang, parts in own.items():
                    grams, n = tally(np.sort(np.concatenate(parts)))
                    held.setdefault(lang, []).append(np.stack([grams.astype(np.int64), n]))
            for lang, parts in held.items():
                grams, n = np.concatenate(parts, axis=1)
                order = np.argsort(grams, kind="stable")
                grams, n = grams[order], n[order]
                edges = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else []
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(edges)), pa.array(grams[edges]), pa.array(np.add.reduceat(n, edges))], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")


def profiles(training: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's most frequent n-grams in order; size rows a language come to the driver."""
    counts = gram_counts(training).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for row in sorted(ranked.collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(row.lang, []).append(row.gram)
    return out


def identify(docs: DataFrame, known: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, held_out, text)."""
    names = sorted(known)
    grams = np.unique(np.array([g for name in names for g in known[name]] or [0], dtype=np.uint32))
    ranks = np.full((max(1, len(names)), len(grams)), -1, dtype=np.int64)
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(grams, np.array(known[name], dtype=np.uint32))] = np.arange(len(known[name]))

    def nearest(own: np.ndarray) -> tuple[str, float]:
        top = top_grams(*tally(own), size)
        at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
        place = np.where(grams[at] == top, ranks[:, at], -1)
        far = np.where(place < 0, size, np.abs(place - np.arange(len(top)))).sum(axis=1)
        best = int(far.argmin())
        return names[best], max(0.0, 1.0 - far[best] / (size * len(top)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(UNKNOWN, 0.0)] * batch.num_rows
            for low, rows in slice_grams(batch.column(2)):
                for i, own in enumerate(rows):
                    if len(own) and names:
                        found[low + i] = nearest(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = docs.filter(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return identify(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text"), profiles(known))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, text,
    coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 3 = 1, false) AS held_out FROM documents
), u AS (SELECT r, unnest(list_concat([''], regexp_extract_all(text, '(?s).'))) AS x, unnest(range(0, length(text) + 1)) AS i FROM d WHERE text IS NOT NULL
), l AS (SELECT x, CASE WHEN regexp_full_match(x, '\p{L}') THEN unicode(lower(x)) % 1021 + 1 ELSE 0 END::BIGINT AS a FROM (SELECT DISTINCT x FROM u)
), s AS (SELECT r, a, coalesce(lead(a) OVER w, 0) AS b, coalesce(lead(a, 2) OVER w, 0) AS c FROM u JOIN l USING (x) WINDOW w AS (PARTITION BY r ORDER BY i)
), g AS (SELECT r, gram, count(*) AS n FROM (
    SELECT r, unnest([CASE WHEN a > 0 THEN a + 1073741824 END, CASE WHEN a > 0 OR b > 0 THEN a * 1024 + b + 2147483648 END, CASE WHEN b > 0 THEN a * 1048576 + b * 1024 + c + 3221225472 END]) AS gram FROM s)
  WHERE gram IS NOT NULL GROUP BY r, gram
), p AS (SELECT lang, gram, k FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS k
    FROM g JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram) WHERE k < 300
), t AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS j FROM g QUALIFY j < 300
), f AS (SELECT t.r, names.lang, sum(coalesce(abs(p.k - t.j), 300))::BIGINT AS far, count(*) AS own
  FROM t CROSS JOIN (SELECT DISTINCT lang FROM p) names LEFT JOIN p ON p.lang = names.lang AND p.gram = t.gram GROUP BY t.r, names.lang
), z AS (SELECT r, lang, greatest(0.0::DOUBLE, 1.0::DOUBLE - far::DOUBLE / (300 * own)::DOUBLE) AS score FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(z.lang, 'und') AS lang_pred, coalesce(score, 0) AS score FROM d LEFT JOIN z USING (r)
"""
