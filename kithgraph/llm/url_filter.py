"""URL rules looked up in a cascade of Bloom filters.

The keys that the corpus can ask for (each host suffix with each path prefix of a rule's length) are its
complete key universe. A cascade answers membership of a list over that universe without error: the first
filter holds the listed keys, the second those other keys that pass the first, the third the listed keys
that pass the second, and so on until none passes. Only the filters travel to the tasks; their size follows
the list, not the corpus, so no join is needed. One cascade holds the blocking rules, one the allowing.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a url without a
rule is not on a list and is allowed; null page_id is kept; repeated rows are judged alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import materialize, table
from kithgraph.llm.textscan import mix

#: host and path prefix, verdict
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level:
    """One Bloom filter: 64-bit words and a number of hash functions."""

    def __init__(self, words: np.ndarray, hashes: int, salt: int) -> None:
        self.words, self.hashes, self.salt = words, hashes, salt

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), dtype=bool)
        for at in bit_places(first, second, len(self.words), self.hashes, self.salt):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bit_places(first: np.ndarray, second: np.ndarray, words: int, hashes: int, salt: int) -> Iterator[np.ndarray]:
    """Bits of each key; levels with different salts are independent."""
    own = mix(first + np.uint64(salt + 1) * second)
    for i in range(hashes):
        yield (own + np.uint64(i) * mix(second)) % np.uint64(64 * words)


class Cascade:
    """Levels that alternate between listed keys and the others that passed."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def passed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many levels hold each key before the first that doesn't."""
        depth, going = np.zeros(len(first), np.int64), np.ones(len(first), dtype=bool)
        for level in self.levels:
            going = going & level.holds(first, second)
            depth += going
        return depth

    def lists(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe."""
        return self.passed(first, second) % 2 == 1


def hashes(key: str | Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))


def through(df: DataFrame, cascade: Cascade) -> DataFrame:
    """df (key, first, second, listed) with ``depth``, the levels that hold the key."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = (np.asarray(b.column(i)).view(np.uint64) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cascade.passed(first, second))], names=[*b.schema.names, "depth"])

    return df.mapInArrow(test, "key string, first long, second long, listed boolean, depth long")


def level_of(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A filter of n keys with the false-positive rate; its bits are gathered by word."""
    k = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
            at = np.unique(np.concatenate(list(bit_places(first, second, words, k, salt))))
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

    found = keys.select("first", "second").mapInArrow(positions, "word long, bit long")
    out = np.zeros(words, dtype=np.int64)
    # At most ``words`` rows, a few bits for each key of the list.
    for row in found.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[row.word] = row.bits
    return Level(out.view(np.uint64), k, salt)


def build(universe: DataFrame, listed: list[str]) -> Cascade:
    """The cascade of the listed keys over the universe (key, first, second)."""
    cascade = Cascade()
    # Spark broadcasts the list only if it is small.
    keys = universe.sparkSession.createDataFrame([(x, True) for x in sorted(set(listed))], "key string, listed boolean")
    left = universe.join(keys, "key", "left").select("key", "first", "second", F.coalesce("listed", F.lit(False)).alias("listed"))
    counts = left.agg(F.count_if("listed").alias("r"), F.count("*").alias("u")).first()
    inside, n = True, counts.r
    rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(1, counts.u - n)))
    while n:
        # A key belongs to this level if it passed all before; the first level takes the listed keys.
        reached = through(left, cascade).filter(F.col("depth") == len(cascade.levels)).drop("depth")
        cascade.levels.append(level_of(reached.filter(F.col("listed") == inside), n, rate, len(cascade.levels)))
        inside, rate = not inside, 0.5
        n = through(left.filter(F.col("listed") == inside), cascade).filter(F.col("depth") == len(cascade.levels)).count()
    return cascade


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def lookup_keys(host: str, path: str, lengths: list[int], most_labels: int) -> Column:
    """Keys that a url can match, longest first; no rule's host has more than ``most_labels`` labels."""
    labels = F.col("labels")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, most_labels), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.concat(s, F.col(path).substr(F.lit(1), n)))))
    longest = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(longest)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    host, path = parts()
    lengths = sorted({len(rule) - rule.index("/") for rule, _ in rules})
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    most = max((rule[: rule.index("/")].count(".") + 1 for rule, _ in rules), default=1)
    end = F.split(F.substring_index("host", ".", -most), r"\.")
    urls = urls.withColumn("labels", end).withColumn("keys", lookup_keys("host", "path", lengths, most)).drop("labels")
    keys = urls.select(F.explode("keys").alias("key")).distinct()
    universe = materialize(keys.select("key", *(h.alias(n) for h, n in zip(hashes("key"), ("first", "second"), strict=True))), "keys")
    cascades = {verdict: build(universe, [r for r, v in rules if v == verdict]) for verdict in ("block", "allow")}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            counts = np.asarray(pa.compute.list_value_length(keys))
            flat, first, second = keys.flatten(), *(np.asarray(b.column(n).flatten()).view(np.uint64) for n in ("first", "second"))
            row = np.repeat(np.arange(b.num_rows), counts)
            rule, verdict = np.full(b.num_rows, -1), np.array(["allow"] * b.num_rows, dtype=object)
            for name, cascade in cascades.items():
                hit = np.flatnonzero(cascade.lists(first, second))[::-1]
                own = np.full(b.num_rows, len(flat))
                own[row[hit]] = hit
                better = (own < len(flat)) & ((rule < 0) | (own < rule))
                rule[better], verdict[better] = own[better], name
            found = flat.take(pa.array(np.where(rule < 0, None, rule), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found, pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    asked = urls.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: hashes(k)[0]).alias("first"), F.transform("keys", lambda k: hashes(k)[1]).alias("second"))
    return asked.mapInArrow(look, "page_id long, host string, path string, rule string, verdict string")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT p.page_id, p.host, p.path,
       (SELECT r.host || r.path FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.verdict FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        ORDER BY length(r.host || r.path) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
