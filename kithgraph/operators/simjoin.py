"""Nearest neighbours and similarity joins over vector tables.

Exact ones run on blocks whose pairs are left out where the triangle inequality shows that they hold nothing
(``cells``); a nearest-neighbour search first looks into the blocks next to each block and then only into those
that may still hold something nearer. ``ann_join`` looks into an inverted file instead: lists by nearest centre,
of which each vector probes a few, as many as a recall needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.operators.cells import BLOCK_ROWS, ROUNDED, Meeting, Reduce, sampled, stacked
from kithgraph.sources.storage import saved

#: Rows that centres are fitted on and probes are chosen by; rows for each centre of them; most centres; turns of the fit.
CENTRE_SAMPLE, ROWS_A_CENTRE, MOST_CENTRES, TURNS = 4096, 3, 512, 12
#: Blocks that a block looks into before its bounds are known.
FIRST_BLOCKS = 2


def block_reduce(a: DataFrame, b: DataFrame, reduce: Reduce, schema: str, least: float | None = None, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """reduce(rows of a, rows of b, their similarities) for tiles of pairs of blocks that may hold similarities from ``least`` on."""
    return Meeting(a, None if b is a else b).reduce(reduce, schema, least=least, combine=combine)


def threshold_pairs(min_sim: float) -> Reduce:
    def pairs(x: pd.DataFrame, y: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        rows, columns = np.nonzero(sims >= min_sim)
        return pd.DataFrame({"id_a": x.id.to_numpy()[rows], "id_b": y.id.to_numpy()[columns], "sim": sims[rows, columns]})

    return pairs


def nearest_pairs(k: int) -> Reduce:
    """The k most similar of each row and what ties with them; where rows have a ``floor`` (null: none), only what reaches it."""

    def pairs(x: pd.DataFrame, y: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        if "floor" in x and x.floor.notna().all() and (reached := sims >= x.floor.to_numpy()[:, None] - ROUNDED).sum() <= 2 * k * len(x):
            rows, columns = np.nonzero(reached)
        elif sims.shape[1] > k:
            # Ties at the cut all stay; the global pick orders them.
            rows, columns = np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, -k][:, None] - ROUNDED)
        else:
            rows, columns = np.nonzero(np.ones_like(sims, dtype=bool))
        return pd.DataFrame({"id_a": x.id.to_numpy()[rows], "id_b": y.id.to_numpy()[columns], "sim": sims[rows, columns]})

    return pairs


PAIR = "id_a long, id_b long, sim double"


def ranked(near: DataFrame, k: int) -> DataFrame:
    near = near.withColumn("sim", F.round("sim", 6))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("id_a").orderBy(F.col("sim").desc(), "id_b"))).filter(F.col("rank") <= k)


def knn(queries: DataFrame, base: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """The k most similar base rows of each query, ranked from 1; ties by id."""
    met = Meeting(queries.select("id", "vector"), None if base is queries else base.select("id", "vector"), rows=rows)
    if met.small:
        return ranked(met.reduce(nearest_pairs(k), PAIR), k)
    every = saved(met.pairs())
    order = W.partitionBy("a_block").orderBy(F.col("most").desc(), "b_block")
    before = F.sum("b_rows").over(order.rowsBetween(W.unboundedPreceding, -1))
    first = saved(every.withColumn("_turn", F.row_number().over(order)).withColumn("_before", F.coalesce(before, F.lit(0))).filter((F.col("_turn") <= FIRST_BLOCKS) | (F.col("_before") < k)))
    found = saved(ranked(met.reduce(nearest_pairs(k), PAIR, first, bundled=True), k))
    # Whoever has k neighbours needs no block that holds nothing as near as the last of them.
    last = found.filter(F.col("rank") == k).join(met.a.table.select(F.col("id").alias("id_a"), "_block"), "id_a")
    floors = last.groupBy("_block").agg(F.min("sim").alias("floor"), F.count("*").alias("full"))
    whole = met.a.spans.select("_block", "n").join(floors, "_block", "left")
    whole = whole.select(F.col("_block").alias("a_block"), F.when(F.col("full") == F.col("n"), F.col("floor") - ROUNDED).otherwise(-2.0).alias("floor"))
    rest = every.join(first.select("a_block", "b_block"), ["a_block", "b_block"], "left_anti").join(whole, "a_block").filter("most >= floor")
    own = found.filter(F.col("rank") == k).select(F.col("id_a").alias("id"), F.col("sim").alias("floor"))
    return ranked(found.drop("rank").unionByName(met.reduce(nearest_pairs(k), PAIR, rest, also=own, bundled=True)), k)


def similarity_join(a: DataFrame, b: DataFrame, min_sim: float, rows: int | None = None) -> DataFrame:
    # A task hands on all similar pairs of two blocks, so these stay small.
    met = Meeting(a.select("id", "vector"), None if b is a else b.select("id", "vector"), rows=rows or BLOCK_ROWS)
    return met.reduce(threshold_pairs(min_sim), PAIR, least=min_sim).withColumn("sim", F.round("sim", 6))


def similar_pairs(table: DataFrame, min_sim: float, rows: int | None = None) -> DataFrame:
    """The similar pairs of a table's own rows, each once with the smaller id first; two blocks meet one way only."""

    def pairs(x: pd.DataFrame, y: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        found = threshold_pairs(min_sim)(x, y, sims)
        if x["_block"].iloc[0] == y["_block"].iloc[0]:
            return found[found.id_a < found.id_b]
        found["id_a"], found["id_b"] = np.minimum(found.id_a, found.id_b), np.maximum(found.id_a, found.id_b)
        return found[found.id_a < found.id_b]

    met = Meeting(table.select("id", "vector"), rows=rows or BLOCK_ROWS)
    return met.reduce(pairs, PAIR, least=min_sim, blocks=True, once=True).withColumn("sim", F.round("sim", 6))


def similar_counts(table: DataFrame, min_sim: float) -> DataFrame:
    """id, degree of a table's rows that have other similar rows: counts of blocks are added up, pairs never leave a task."""

    def counts(x: pd.DataFrame, y: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        near, ids, others = sims >= min_sim, x.id.to_numpy(), y.id.to_numpy()
        if np.isin(ids, others).any():
            near &= ids[:, None] != others[None]
        degree = near.sum(axis=1)
        return pd.DataFrame({"id": ids[degree > 0], "degree": degree[degree > 0]})

    met = Meeting(table.select("id", "vector")).reduce(counts, "id long, degree long", least=min_sim)
    return met.groupBy("id").agg(F.sum("degree").alias("degree"))


# --- inverted file -------------------------------------------------------------------------------------------------


@dataclass
class InvertedFile:
    """Unit centres; each vector is in the list of its nearest, and probes the lists of its ``probes`` nearest."""

    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        near = vectors @ self.centres.T
        n = min(n, near.shape[1])
        return np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.tile(np.arange(n), (len(near), 1))


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fit_inverted_file(base: DataFrame, min_sim: float, recall: float, both: bool = True) -> InvertedFile:
    """Centres of k-means on ``CENTRE_SAMPLE`` rows at most, and the fewest probes that find ``recall`` of the sample's own pairs.

    With ``both`` a pair is found once either side probes the other's list, else only the first one probes.
    """
    rows = sampled(base, base.count()).limit(CENTRE_SAMPLE).collect()
    own = np.array([r.vector for r in rows], dtype=np.float64)
    if not len(own):
        return InvertedFile(np.zeros((1, 0)), 1)
    k = max(1, min(MOST_CENTRES, len(own) // ROWS_A_CENTRE))
    centres = unit(own[:k])
    for _ in range(TURNS):
        at = (own @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, own)
        empty = np.bincount(at, minlength=k) == 0
        centres = np.where(empty[:, None], centres, unit(sums))
    order = np.argsort(-(own @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each centre in each row's order
    near = own @ own.T >= min_sim
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    if not len(a):
        return InvertedFile(centres, 1)
    home = order[:, 0]
    needed = np.sort(np.minimum(place[a, home[b]], place[b, home[a]]) if both else place[a, home[b]])
    return InvertedFile(centres, 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]))


def ann_join(a: DataFrame, b: DataFrame | None, min_sim: float, recall: float = 0.95, rows: int | None = None) -> tuple[DataFrame, float]:
    """Pairs of vectors from min_sim, most of them, and the share of all pairs that was looked at.

    Every row of b is in one list of an inverted file; a row of a meets the lists it probes, so no pair is met
    twice. Lists are cut by hash into blocks, on both sides, so that a long list is many tasks. Without b the pairs
    are those of a with itself, the smaller id first, and found if either side probes the other.
    """
    limit = rows or BLOCK_ROWS
    left = saved(a.select(F.col("id").alias("id"), F.col("vector").alias("vector")).filter("vector IS NOT NULL"))
    right = left if b is None else saved(b.select(F.col("id").alias("id"), F.col("vector").alias("vector")).filter("vector IS NOT NULL"))
    file = fit_inverted_file(right, min_sim, recall, b is None)

    def listed(df: DataFrame, n: int) -> DataFrame:
        def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    own = file.nearest(stacked(batch.vector), n)
                    yield batch.loc[batch.index.repeat(own.shape[1])].assign(_list=own.ravel())

        return df.mapInPandas(lists, f"id long, vector {df.schema['vector'].dataType.simpleString()}, _list long")

    asked, held = saved(listed(left, file.probes)), saved(listed(right, 1))
    sizes = {}
    for name, df in (("a", asked), ("b", held)):
        sizes[name] = {r["_list"]: r.n for r in df.groupBy("_list").agg(F.count("*").alias("n")).collect()}
    looked = sum(n * sizes["b"].get(at, 0) for at, n in sizes["a"].items())
    cuts = {name: [max(1, -(-own.get(i, 0) // limit)) for i in range(len(file.centres))] for name, own in sizes.items()}
    of = {name: F.element_at(F.lit(own), (F.col("_list") + 1).cast("int")) for name, own in cuts.items()}

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), of[own]).cast("int").alias(f"_{own}")
        return df.select("id", "vector", "_list", at, F.explode(F.sequence(F.lit(0), of[other] - 1)).alias(f"_{other}"))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id_a": [], "id_b": [], "sim": []})
        return threshold_pairs(min_sim)(x, y, np.clip(stacked(x.vector) @ stacked(y.vector).T, -1, 1))

    met = cut(asked, "a", "b").groupBy("_list", "_a", "_b").cogroup(cut(held, "b", "a").groupBy("_list", "_a", "_b")).applyInPandas(product, PAIR)
    n_a, n_b = left.count(), right.count()
    if b is None:
        pair = met.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "sim")
        # A pair that both sides found counts as looked at twice.
        return pair.groupBy("id_a", "id_b").agg(F.max(F.round("sim", 6)).alias("sim")), looked / max(1, n_a * (n_a - 1) / 2)
    return met.withColumn("sim", F.round("sim", 6)), looked / max(1, n_a * n_b)


def unpack_vectors(df: DataFrame, blob: str, name: str) -> DataFrame:
    """Little-endian float32 blobs to arrays."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = [None if x is None else np.frombuffer(x, dtype="<f4") for x in b[blob]]
            yield b.drop(columns=blob)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != blob]
    return df.mapInPandas(unpack, ", ".join([*fields, f"`{name}` array<float>"]))


def pack_vectors(df: DataFrame, vector: str, name: str) -> DataFrame:
    """Arrays to little-endian float32 blobs."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = [None if x is None else np.asarray(x, dtype="<f4").tobytes() for x in b[vector]]
            yield b.drop(columns=vector)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != vector]
    return df.mapInPandas(pack, ", ".join([*fields, f"`{name}` binary"]))
