"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Entries become whole numbers, so tasks add up counts, sums and products exactly and the order of rows and retries
does not matter: ``scatter`` is n * n times the covariance, without rounding, from vectors centred at the whole part
of the mean before they are multiplied. Its characteristic polynomial is computed modulo primes, one Spark row a
prime: a similarity to Hessenberg form, then the recurrence of its leading minors. Chinese remaindering joins the
residues; the number of primes follows from a bound on the coefficients, which for a scatter are elementary
symmetric functions of roots that are not negative. All roots are real, so Descartes' rule counts them exactly: the
sign changes of p(x + a) are the roots above a. Halving intervals isolates the roots to any number of bits, and the
degree of gcd(p, p') modulo the primes tells how many distinct ones there are, so close roots are told from equal
ones. One Spark row a distinct root solves (A - root * I) v = b twice with as many decimals as the roots need; the
solutions of an equal root are made orthogonal. Nothing but the d * d scatter and the components is held by the driver;
the work on them grows with the dimension alone, at most ``MOST_DIMENSIONS``.

Defined results: vectors that are null or hold a null or non-finite entry are left out. The fit needs vectors of
one length: the commonest (ties: the longest); vectors of other lengths have no place in it and are left out too.
Repeated rows count as often as they occur. Components with variance 0 cannot be whitened and are left out, so fewer
vectors than dimensions give fewer components, and equal vectors or an empty table none. Equal variances
share a space; its axes are the ones the solver finds, the same for all rows. A deviation beyond a long is null in
the query. Extra columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import table
from kithgraph.llm.vector_rows import lengths, scaled

MOST_DIMENSIONS = 256
OFFSET = 1_000_000
SLICE_ROWS = 4096
#: Bits of a root beyond those that tell it from its neighbours and from 0.
SPARE_BITS = 80
HALF = 1 << 31


def limbs(value: int) -> tuple[int, int]:
    """value as high * 2**31 + low; sums of both parts over tasks fit 64 bits where one sum would not."""
    return divmod(int(value), HALF)


def summed(parts: DataFrame) -> dict[int, int]:
    """place -> exact total of rows (place, high, low)."""
    return {r.place: r.high * HALF + r.low for r in parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}


def placed(values: list[int]) -> pa.RecordBatch:
    cut = [limbs(v) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([h for h, _ in cut], pa.int64()), pa.array([low for _, low in cut], pa.int64())], names=["place", "high", "low"])


PLACED = "place int, high long, low long"


def common_length(vectors: DataFrame) -> int:
    """The commonest number of entries of vectors without null or non-finite ones; 0 if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(lengths(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["size", "n"])

    sizes = vectors.mapInArrow(count, "size long, n long").filter("size > 0").groupBy("size").agg(F.sum("n").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def gram(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows, exactly: in doubles while all partial sums stay below 2**53."""
    if rows.dtype != object and len(rows) * int(np.abs(rows).max(initial=0)) ** 2 < 1 << 53:
        as_double = rows.astype(np.float64)
        return (as_double.T @ as_double).astype(np.int64).astype(object)
    return rows.astype(object).T @ rows.astype(object)


def count_and_sums(vectors: DataFrame, size: int, scale: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=object)
        for batch in batches:
            _, rows = scaled(batch.column(0), size, scale)
            total[0] += len(rows)
            total[1:] += rows.sum(axis=0).astype(object)
        yield placed(total.tolist())

    found = summed(vectors.mapInArrow(add, PLACED))
    return found[0], [found[i + 1] for i in range(size)]


def scatter(vectors: DataFrame, size: int, scale: int, n: int, sums: list[int]) -> list[list[int]]:
    """n * n times the covariance, exactly: n * sum(z z') - sum(z) sum(z)' of vectors z centred at floor(mean)."""
    centre = [s // n for s in sums]
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), dtype=object)
        for batch in batches:
            _, rows = scaled(batch.column(0), size, scale)
            for low in range(0, len(rows), SLICE_ROWS):
                total += gram(centred(rows[low : low + SLICE_ROWS], centre))[upper]
        yield placed(total.tolist())

    found = summed(vectors.mapInArrow(add, PLACED))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    out = [[0] * size for _ in range(size)]
    for place, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        out[i][j] = out[j][i] = n * found[place] - rest[i] * rest[j]
    return out


def centred(rows: np.ndarray, centre: list[int]) -> np.ndarray:
    """Rows less the centre; 64-bit numbers where they and the centre are small."""
    wide = rows.dtype == object or any(abs(c) >= 1 << 62 for c in centre)
    return rows.astype(object) - np.array(centre, dtype=object) if wide else rows - np.array(centre, dtype=np.int64)


# --- characteristic polynomial -------------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Exact below 3.4 * 10**14 with these witnesses."""
    if any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """Primes below 2**31 whose product is more than bound; at least two."""
    found, product, n = [], 1, HALF - 1
    while product <= bound or len(found) < 2:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to this one modulo p, with zeros below the first subdiagonal."""
    h = matrix.copy()
    for m in range(len(h) - 2):
        below = np.flatnonzero(h[m + 1 :, m])
        if not len(below):
            continue
        pivot = m + 1 + int(below[0])
        h[[m + 1, pivot]] = h[[pivot, m + 1]]
        h[:, [m + 1, pivot]] = h[:, [pivot, m + 1]]
        factor = h[m + 2 :, m] * pow(int(h[m + 1, m]), -1, p) % p
        h[m + 2 :] = (h[m + 2 :] - factor[:, None] * h[m + 1] % p) % p
        h[:, m + 1] = (h[:, m + 1] + (h[:, m + 2 :] * factor % p).sum(axis=1)) % p
    return h


def minors(h: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of the characteristic polynomial of a Hessenberg matrix modulo p."""
    d = len(h)
    found = np.zeros((d + 1, d + 1), dtype=np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        factor, product = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            factor[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        found[k, 1:] = found[k - 1, :-1]
        found[k] = (found[k] - (found[:k] * factor[:, None] % p).sum(axis=0)) % p
    return found[d]


def common_degree(a: list[int], p: int) -> int:
    """Degree of the greatest common divisor of a polynomial and its derivative modulo p."""
    b = [i * c % p for i, c in enumerate(a)][1:]
    while b and not b[-1]:
        b.pop()
    a = list(a)
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            factor, shift = a[-1] * inverse % p, len(a) - len(b)
            for i, c in enumerate(b):
                a[shift + i] = (a[shift + i] - factor * c) % p
            while a and not a[-1]:
                a.pop()
        a, b = b, a
    return len(a) - 1


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> tuple[list[int], int]:
    """Coefficients, lowest first, of det(x I - matrix) for a scatter, and its number of distinct roots."""
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    bound = max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_above(2 * bound + 1)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own = np.array([[x % p for x in row] for row in matrix], dtype=np.int64)
                found = minors(hessenberg(own, p), p).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([found], pa.list_(pa.int64())), pa.array([d - common_degree(found, p)])], names=["p", "residues", "distinct"])

    slots = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, min(len(primes), spark.sparkContext.defaultParallelism)))
    rows = slots.mapInArrow(residues, "p long, residues array<long>, distinct long").collect()
    product = reduce(lambda a, b: a * b, primes)
    out = [0] * (d + 1)
    for row in rows:
        others = product // row.p
        weight = others * pow(others, -1, row.p)
        out = [(x + r * weight) % product for x, r in zip(out, row.residues, strict=True)]
    return [x - product if 2 * x > product else x for x in out], max(row.distinct for row in rows)


# --- roots ---------------------------------------------------------------------------------------------------------


def roots_above(poly: list[int], a: int) -> int:
    """Number of roots above a, counted as often as they are repeated, of a polynomial with real roots only."""
    if a:
        power, own = 1, []
        for c in poly:
            own.append(c * power)
            power *= a
        # p(a x) shifted by 1 is p(a x + a): the same signs as p(x + a).
        for i in range(len(own) - 1):
            own[i:] = list(accumulate(reversed(own[i:])))[::-1]
        poly = own if a > 0 else [c if i % 2 == 0 else -c for i, c in enumerate(own)]
    signs = [c > 0 for c in poly if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def value_sign(poly: list[int], a: int) -> int:
    total = reduce(lambda so_far, c: so_far * a + c, reversed(poly), 0)
    return (total > 0) - (total < 0)


def isolate(poly: list[int], distinct: int) -> tuple[int, list[tuple[int, int]]]:
    """bits, and (place, times) of each distinct root above 0, greatest first.

    A root lies in (place, place + 1] / 2**bits; that is ``SPARE_BITS`` bits finer than the roots' distances from
    each other and from 0.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly, distinct = poly[zeros:], distinct - (zeros > 0)
    d, bits = len(poly) - 1, 8
    if not d:
        return bits, []
    while True:
        fine = [c << (bits * (d - k)) for k, c in enumerate(poly)]
        top = 1 << max(1, (abs(fine[d - 1])).bit_length())  # the sum of roots that are not negative is none of them less
        todo, found = [(0, top, roots_above(fine, 0), 0)], []
        while todo:
            low, high, n_low, n_high = todo.pop()
            if n_low == n_high:
                continue
            if n_low - n_high == 1 and high - low > 1:
                low = halve(fine, low, high)
                high = low + 1
            if high - low == 1:
                found.append((low, n_low - n_high))
                continue
            middle = (low + high) // 2
            n = roots_above(fine, middle)
            todo += [(low, middle, n_low, n), (middle, high, n, n_high)]
        found.sort(reverse=True)
        if len(found) < distinct:
            bits *= 2
            continue
        near = min([found[-1][0], *(a[0] - b[0] for a, b in zip(found, found[1:], strict=False))])
        if near.bit_length() > SPARE_BITS:
            return bits, found
        bits += SPARE_BITS + 2 - near.bit_length()


def halve(poly: list[int], low: int, high: int) -> int:
    """The place of the one root in (low, high], by signs."""
    above = value_sign(poly, high)
    if not above:
        return high - 1
    while high - low > 1:
        middle = (low + high) // 2
        sign = value_sign(poly, middle)
        if not sign:
            return middle - 1
        low, high = (low, middle) if sign == above else (middle, high)
    return low


# --- components ----------------------------------------------------------------------------------------------------


def null_space(matrix: list[list[int]], place: int, times: int, bits: int, digits: int) -> list[list[float]]:
    """``times`` orthogonal unit vectors v with matrix v = root v, by two solutions of (matrix - root) v = b."""
    with decimal.localcontext() as context:
        context.prec, context.Emax, context.Emin = digits, decimal.MAX_EMAX, decimal.MIN_EMIN
        number = decimal.Decimal
        d, root = len(matrix), number(2 * place + 1) / number(2 << bits)
        upper = np.array([[number(x) for x in row] for row in matrix], dtype=object)
        upper[np.diag_indices(d)] -= root
        least = number(1) / number(4 << bits)
        order, factors = np.arange(d), np.full((d, d), number(0), dtype=object)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(upper[k + i, k]))
            for part in (upper, factors, order):
                part[[k, pivot]] = part[[pivot, k]]
            if abs(upper[k, k]) < least:
                upper[k, k] = least
            factors[k + 1 :, k] = upper[k + 1 :, k] / upper[k, k]
            upper[k + 1 :, k:] -= factors[k + 1 :, k][:, None] * upper[k, k:]
        found = np.array([[number((i * 7919 + j * 104729 + i * i * (j + 3)) % 1009 - 504) for j in range(times)] for i in range(d)], dtype=object)
        for _ in range(2):
            found = found[order]
            for k in range(d):
                found[k + 1 :] -= factors[k + 1 :, k][:, None] * found[k]
            for k in range(d - 1, -1, -1):
                found[k] = (found[k] - upper[k, k + 1 :] @ found[k + 1 :] if k < d - 1 else found[k]) / upper[k, k]
            for j in range(times):
                for _ in range(2):
                    for i in range(j):
                        found[:, j] -= found[:, i] * (found[:, i] @ found[:, j])
                found[:, j] /= (found[:, j] @ found[:, j]).sqrt()
        return [[float(x) for x in found[:, j]] for j in range(times)]


def components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[float, float, list[float]]]:
    """Root, its share of the trace, and unit eigenvector, for the ``most`` greatest roots above 0 of a scatter."""
    trace = sum(row[i] for i, row in enumerate(matrix))
    if not trace:
        return []
    poly, distinct = characteristic_polynomial(spark, matrix)
    bits, roots = isolate(poly, distinct)
    before = [0, *accumulate(times for _, times in roots)]
    roots = [root for root, n in zip(roots, before, strict=False) if n < most]
    digits = 30 + int(0.302 * (2 * roots[0][0].bit_length() + bits))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = null_space(matrix, *roots[i], bits, digits)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["root", "axis", "vector"])

    slots = spark.createDataFrame([(i,) for i in range(len(roots))], "root long").repartition(max(1, min(len(roots), spark.sparkContext.defaultParallelism)))
    rows = sorted(slots.mapInArrow(solve, "root long, axis long, vector array<double>").collect(), key=lambda r: (r.root, r.axis))
    out = []
    for row in rows[:most]:
        place = 2 * roots[row.root][0] + 1
        out.append((place / (2 << bits), place / (trace * (2 << bits)), list(row.vector)))
    return out


# --- whitening -----------------------------------------------------------------------------------------------------


def deviations(rows: np.ndarray, n: int, sums: list[int], centre: list[int]) -> np.ndarray:
    """n * x - sums of each row and dimension, exactly."""
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    own = centred(rows, centre)
    if own.dtype == object or n * max(int(np.abs(own).max(initial=0)), 1) + max(map(abs, rest)) >= 1 << 62:
        return n * own.astype(object) - np.array(rest, dtype=object)
    return n * own - np.array(rest, dtype=np.int64)


def lengths_squared(rows: np.ndarray) -> list[int]:
    if rows.dtype != object and rows.shape[1] * int(np.abs(rows).max(initial=0)) ** 2 < 1 << 62:
        return (rows * rows).sum(axis=1).tolist()
    wide = rows.astype(object)
    return [int(x) for x in (wide * wide).sum(axis=1)]


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = OFFSET) -> DataFrame:
    """vec_id, n, deviation (decimal), whitened and explained (arrays), identity_error of every vector with a place.

    The offset moves every entry and its mean alike, so it cancels exactly and is never added.
    """
    spark, rows = vectors.sparkSession, vectors.select("embedding")
    schema = "vec_id long, n long, deviation string, whitened array<double>"
    size = common_length(rows)
    if size > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")
    n, sums = count_and_sums(rows, size, scale) if size else (0, [])
    found = components(spark, scatter(rows, size, scale, n, sums), most) if n else []
    centre = [s // n for s in sums] if n else []
    axes = np.array([v for _, _, v in found]).T.reshape(size, len(found)) / np.sqrt([root for root, _, _ in found])
    upper = np.triu_indices(len(found))

    def project(column: pa.Array) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
        at, own = scaled(column, size, scale)
        for low in range(0, len(own), SLICE_ROWS):
            apart = deviations(own[low : low + SLICE_ROWS], n, sums, centre)
            yield at[low : low + SLICE_ROWS], lengths_squared(apart), apart.astype(np.float64) @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]))
        for batch in batches:
            for _, _, white in project(batch.column(0)):
                total += (white.T @ white)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "total"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, apart, white in project(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([n] * len(at), pa.int64()), pa.array([str(x) for x in apart]), lists], names=["vec_id", "n", "deviation", "whitened"])

    error = None
    if found:
        # whitened vectors are centred exactly, so their products are their covariance
        rows_of = rows.mapInArrow(moments, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        error = max(abs(r.total / n - (upper[0][r.place] == upper[1][r.place])) for r in rows_of)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    out = out.mapInArrow(results, schema) if size else spark.createDataFrame([], schema)
    shares = F.array(*(F.lit(share) for _, share, _ in found)).cast("array<double>")
    return out.select("vec_id", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x")
    rows = whiten(table(spark, sf_dir, "embeddings")).select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
