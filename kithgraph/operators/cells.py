"""Vector tables as blocks whose similarities are bounded before they meet.

Pivots are directions picked from a bounded sample, each far from the ones before. Every vector keeps its angles to
all pivots and belongs to the cell of the nearest one; a cell is cut along the angle to its pivot into blocks of
about ``BLOCK_ROWS`` rows, and many vectors at one angle are cut by hash. A block's angles to a pivot span an
interval. By the triangle inequality on the sphere two vectors are at least as far apart as the gap between their blocks'
intervals, for every pivot, so a pair of blocks whose largest gap leaves no room for a similarity is never formed.
What travels is each block once for every block that it has to meet. Blocks of large tables are larger, so that a table has about
``BLOCKS`` of them and a row travels about as often whatever the table's size is; a task forms the similarities of two blocks a tile
at a time, so its memory does not depend on the blocks' sizes.

Laid tables are written to the shared folder and read from there in every round. The driver holds the sample
(``SAMPLE_ROWS``), the pivots and the counts of ``PIVOTS`` * ``RINGS`` rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.sources.storage import saved

BLOCK_ROWS = 4096
#: Blocks that a large table is cut into about; rows of a block at most; similarities that a task holds at a time.
BLOCKS, MOST_BLOCK_ROWS, TILE_CELLS = 24, 32768, 1 << 21
PIVOTS, RINGS, SAMPLE_ROWS = 16, 128, 4096
#: Room for rounding: of angles and products, and of similarities rounded to six digits.
SLACK, ROUNDED = 1e-7, 1e-6

Reduce = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame]
#: Of two blocks and their tiles.
Fold = Callable[[pd.DataFrame, pd.DataFrame, Iterator[tuple[slice, np.ndarray]]], pd.DataFrame]


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def tiles(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of x and their similarities to all of y, some rows at a time."""
    left, right = stacked(x.vector), stacked(y.vector).T
    step = max(1, TILE_CELLS // len(y))
    for low in range(0, len(x), step):
        sims = left[low : low + step] @ right
        yield slice(low, low + step), np.clip(sims, -1, 1, out=sims)


def sampled(table: DataFrame, n: int) -> DataFrame:
    """The ``SAMPLE_ROWS`` rows with the smallest hashes, of n; about twice as many reach the sort, however many tasks there are."""
    some = table.filter("vector IS NOT NULL")
    if n > 2 * SAMPLE_ROWS:
        some = some.filter(F.xxhash64("id") < int(2**64 * 2 * SAMPLE_ROWS / n) - 2**63)
    return some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of the sample: the first is the farthest from the mean, each next the farthest from those chosen."""
    sizes = np.linalg.norm(sample, axis=1)
    rows = sample[sizes > 0] / sizes[sizes > 0, None]
    if not len(rows):
        return np.zeros((0, sample.shape[1] if sample.ndim > 1 else 0))
    chosen = [int((rows @ rows.mean(axis=0)).argmin())]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(most, len(rows)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


@dataclass
class Laid:
    """A saved table with the columns it had and ``_block``; its number of rows and of blocks."""

    table: DataFrame
    rows: int
    blocks: int
    columns: list[str]
    pivots: int

    @cached_property
    def spans(self) -> DataFrame:
        """_block, cell, n, norm, and the least and greatest angle to each pivot; one row a block."""
        angles = [f(F.col("_angles")[i]).alias(f"{name}{i}") for i in range(self.pivots) for name, f in (("lo", F.min), ("hi", F.max))]
        return saved(self.table.groupBy("_block").agg(F.first("_cell").alias("cell"), F.count("*").alias("n"), F.max("_norm").alias("norm"), F.min("_norm").alias("least_norm"), *angles))


    def bundles(self, others: int) -> DataFrame:
        """_block, _bundle: neighbouring blocks, ``MOST_BLOCK_ROWS`` rows and a block at most, but so many that they make ``BLOCKS`` tasks with ``others``."""
        most = -(-self.rows // max(1, -(-self.rows // MOST_BLOCK_ROWS), -(-BLOCKS // max(1, others))))
        before = F.coalesce(F.sum("n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return self.spans.select("_block", F.floor(before / max(1, most)).alias("_bundle"))


def lay(table: DataFrame, pivots: np.ndarray, part: str | None = None, rows: int | None = None) -> Laid:
    """Blocks of a table with id and vector (rows without a vector have no similarity and are left out).

    With ``part`` every value of that column has blocks of its own, cut by hash.
    """
    columns = table.columns
    table = table.filter("vector IS NOT NULL")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema), "_cell int, _ring int, _norm double, _angles array<double>"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = stacked(batch.vector)
            size = np.linalg.norm(own, axis=1)
            near = np.clip(own @ pivots.T / np.where(size > 0, size, 1)[:, None], -1, 1) if len(pivots) else np.zeros((len(own), 1))
            angles = np.arccos(near)
            cell = angles.argmin(axis=1)
            ring = np.minimum((angles[np.arange(len(own)), cell] * (RINGS / np.pi)).astype(int), RINGS - 1)
            yield batch.assign(_cell=cell, _ring=ring, _norm=size, _angles=list(angles))

    placed = saved(table.mapInPandas(place, schema))
    if part is not None:
        counts = placed.groupBy(F.col(part).alias("_part")).agg(F.count("*").alias("_n"))
        limit = F.lit(rows) if rows else F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(MOST_BLOCK_ROWS), F.ceil(F.col("_n") / BLOCKS)))
        hashed = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / limit))
        laid = placed.join(counts, F.col(part).eqNullSafe(F.col("_part"))).withColumn("_block", F.struct(F.col(part).alias("part"), hashed.alias("at"))).drop("_part", "_n")
        n = placed.count()
        return Laid(laid, n, -1, columns, max(1, len(pivots)))
    rings = {(r["_cell"], r["_ring"]): r.n for r in placed.groupBy("_cell", "_ring").agg(F.count("*").alias("n")).collect()}
    limit = rows or max(BLOCK_ROWS, min(MOST_BLOCK_ROWS, -(-sum(rings.values()) // BLOCKS)))
    first, parts = np.zeros((PIVOTS + 1) * RINGS, dtype=int), np.ones((PIVOTS + 1) * RINGS, dtype=int)
    block, held, last = -1, 0, None
    for (cell, ring), n in sorted(rings.items()):
        if cell != last or held + n > limit:
            block, held, last = block + 1, 0, cell
        cuts = -(-n // limit)
        first[cell * RINGS + ring], parts[cell * RINGS + ring] = block, cuts
        block, held = (block, held + n) if cuts == 1 else (block + cuts - 1, limit)
    at = F.col("_cell") * RINGS + F.col("_ring") + 1
    number = F.element_at(F.lit(first.tolist()), at) + F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts.tolist()), at))
    return Laid(placed.withColumn("_block", number.cast("long")), sum(rings.values()), block + 1, columns, max(1, len(pivots)))


def pivots_of(table: DataFrame, n: int) -> np.ndarray:
    """Pivots of a table of n rows."""
    sample = [r.vector for r in sampled(table.select("id", "vector"), n).collect()]
    return choose_pivots(np.array(sample, dtype=np.float64), PIVOTS) if sample else np.zeros((0, 0))


class Meeting:
    """Two laid tables (or one with itself) and the pairs of blocks that may hold similar vectors."""

    def __init__(self, a: DataFrame, b: DataFrame | None = None, part: str | None = None, rows: int | None = None, pivots: np.ndarray | None = None) -> None:
        left = saved(a)
        right = left if b is None else saved(b)
        n = right.count()
        small = part is None and max(left.count(), n) <= (rows or BLOCK_ROWS)
        if pivots is None:
            pivots = np.zeros((0, 0)) if small else pivots_of(right, n)
        if small:
            self.a, self.b = whole(left), whole(right)
        else:
            self.a = lay(left, pivots, part, rows)
            self.b = self.a if b is None else lay(right, pivots, part, rows)
        self.small, self.part = small, part

    def with_other(self, table: DataFrame, columns: list[str]) -> Meeting:
        """The first table and another one whose rows have the first's columns and blocks of their own."""
        other = object.__new__(Meeting)
        other.a, other.small, other.part = self.a, self.small, None
        other.b = Laid(table, self.a.rows, -1, columns, self.a.pivots)
        return other

    def near_cells(self, least: float | None) -> DataFrame:
        """Pairs of cells (a_cell, b_cell) that may hold similarities from ``least`` on: PIVOTS * PIVOTS rows at most."""
        sides = []
        for laid in (self.a, self.b):
            ends = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(laid.pivots) for name, f in (("lo", F.min), ("hi", F.max))]
            sides.append(laid.spans.groupBy("cell").agg(F.max("norm").alias("norm"), *ends).toPandas())
        a, b = sides
        gap = np.zeros((len(a), len(b)))
        for i in range(self.a.pivots):
            gap = np.maximum(gap, np.maximum(b[f"lo{i}"].to_numpy()[None] - a[f"hi{i}"].to_numpy()[:, None], a[f"lo{i}"].to_numpy()[:, None] - b[f"hi{i}"].to_numpy()[None]))
        most = np.maximum(np.cos(gap), 0) * a.norm.to_numpy()[:, None] * b.norm.to_numpy()[None] + SLACK
        row, column = np.nonzero(most >= (-np.inf if least is None or least <= 0 else least))
        cells = pd.DataFrame({"acell": a.cell.to_numpy()[row], "bcell": b.cell.to_numpy()[column]})
        return self.a.table.sparkSession.createDataFrame(cells, "acell int, bcell int")

    def pairs(self, least: float | None = None) -> DataFrame:
        """a_block, b_block, their rows, the bounds most and least of their similarities: pairs that may reach ``least``; all without it.

        With parts, only blocks of one part are paired.
        """
        left = self.a.spans.select(*(F.col(c).alias(f"a{c}") for c in self.a.spans.columns))
        right = self.b.spans.select(*(F.col(c).alias(f"b{c}") for c in self.b.spans.columns))
        if self.part is not None:
            both = left.join(right, F.col("a_block.part").eqNullSafe(F.col("b_block.part")))
        else:
            both = left.join(F.broadcast(self.near_cells(least)), "acell").join(right, "bcell")
        n = self.a.pivots
        gaps = [F.greatest(F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}")) for i in range(n)]
        # Angles to a pivot add up: no two vectors are farther apart than the sum, or than what is left of a full turn.
        ends = [F.least(F.col(f"ahi{i}") + F.col(f"bhi{i}"), 2 * np.pi - F.col(f"alo{i}") - F.col(f"blo{i}")) for i in range(n)]
        gap, reach = F.greatest(F.lit(0.0), F.lit(0.0), *gaps), F.least(F.lit(np.pi), F.lit(np.pi), *ends)
        size, small = F.col("anorm") * F.col("bnorm"), F.col("aleast_norm") * F.col("bleast_norm")
        most = F.when(F.cos(gap) > 0, F.cos(gap) * size).otherwise(F.cos(gap) * small) + SLACK
        lowest = F.when(F.cos(reach) < 0, F.cos(reach) * size).otherwise(F.cos(reach) * small) - SLACK
        found = both.select("a_block", "b_block", F.col("an").alias("a_rows"), F.col("bn").alias("b_rows"), most.alias("most"), lowest.alias("least"))
        return found if least is None else found.filter(F.col("most") >= least)

    def reduce(self, reduce: Reduce, schema: str, pairs: DataFrame | None = None, least: float | None = None, blocks: bool = False, once: bool = False, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None, also: DataFrame | None = None, bundled: bool = False) -> DataFrame:
        """reduce(rows of a, rows of b, their similarities) for every tile of every pair of blocks; ``combine`` merges what a pair's tiles gave."""

        def fold(x: pd.DataFrame, y: pd.DataFrame, parts: Iterator[tuple[slice, np.ndarray]]) -> pd.DataFrame:
            found = [part for part in (reduce(x.iloc[at], y, sims) for at, sims in parts) if len(part)]
            if not found:
                return pd.DataFrame({name: [] for name in names})
            whole = pd.concat(found, ignore_index=True)
            return whole if combine is None else combine(whole)

        names = [field.split()[0] for field in schema.split(", ")]
        return self.fold(fold, schema, pairs, least, blocks, once, also, bundled=bundled)

    def fold(self, fold: Fold, schema: str, pairs: DataFrame | None = None, least: float | None = None, blocks: bool = False, once: bool = False, also: DataFrame | None = None, only: Column | None = None, bundled: bool = False) -> DataFrame:
        """fold(rows of a, rows of b, tiles) for every pair of blocks; with ``blocks`` rows keep ``_block``.

        With ``once`` two blocks of a table that meets itself meet one way only; ``also`` has further columns of a's rows by id, and
        rows of a outside ``only`` stay away. ``bundled``: a block of a meets neighbouring blocks of b as one, so that it travels once for all of them.
        """
        names = [field.split()[0] for field in schema.split(", ")]

        def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({name: [] for name in names})
            return fold(x, y, tiles(x, y))

        own = ["_block"] if blocks else []
        # New names give both sides columns of their own, so a table may meet itself.
        left, right = (side.table.select(*(F.col(c).alias(c) for c in (*side.columns, *own)), F.col("_block").alias(name)) for side, name in ((self.a, "_a"), (self.b, "_b")))
        if only is not None:
            left = left.filter(only)
        if also is not None:
            left = left.join(also, "id", "left")
        if self.small:
            return left.groupBy("_a").cogroup(right.groupBy("_b")).applyInPandas(product, schema)
        met = self.pairs(least) if pairs is None else pairs
        met = (met.filter("a_block <= b_block") if once else met).select(F.col("a_block").alias("_a"), F.col("b_block").alias("_b"))
        if bundled:
            met = met.join(F.broadcast(self.b.bundles(self.a.blocks)), F.col("_b") == F.col("_block")).drop("_block")
            bundles = met.select("_a", F.col("_bundle").alias("_with")).distinct()
            return left.join(bundles, "_a").groupBy("_a", "_with").cogroup(right.join(met, "_b").groupBy("_a", "_bundle")).applyInPandas(product, schema)
        return left.join(met, "_a").groupBy("_a", "_b").cogroup(right.join(met, "_b").groupBy("_a", "_b")).applyInPandas(product, schema)


def whole(table: DataFrame) -> Laid:
    """A table of one block at most."""
    return Laid(table.filter("vector IS NOT NULL").withColumn("_block", F.lit(0).cast("long")), 0, 1, table.columns, 0)
