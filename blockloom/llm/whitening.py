"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

1. Every number c becomes the integer x = floor(1024 c) + 100000.  Spark sums the vectors and their products
   exactly, in limbs of 40 bits, so the integer scatter M = n sum(x x') - S S' is exact at any number of rows;
   the covariance of x is M / n^2.
2. M's characteristic polynomial is found modulo 31-bit primes, by reduction to Hessenberg form, one Spark row per
   prime, and put together by Chinese remaindering; the bound on its coefficients follows from M's trace.
3. Its largest roots are isolated by Descartes' rule, which is exact for polynomials whose roots are all real, and
   narrowed to a relative width of 2^-100.
4. Components come from inverse iteration at those roots, in integers of fixed point, each made orthogonal to those
   before; so close or equal eigenvalues cost no precision.

What the driver holds depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB = 40  # bits; four limbs hold sums of products of any two longs over 2^33 rows
ROOT_BITS = 100  # relative precision of eigenvalues
WORK_BITS = 320  # of the fixed point in which components are solved
MODULUS_TOP = 2**31  # primes below: products of two residues fit a long


def usable(column: Column) -> Column:
    """Not null, not empty, and each entry a finite number."""
    good = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & F.coalesce(good, F.lit(False))


def prepared(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector as doubles) of the usable rows of the most frequent dimension (the smaller one of a tie), and that dimension."""
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")))
    most = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = most["d"] if most else 0
    return vectors.where(F.size("v") == dimension), dimension


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """y = x - SHIFT as longs, a row per vector; beyond a long, the nearest one."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    low, high = -(2.0**62), 2.0**62
    return np.clip(flat, low, high).astype(np.int64).reshape(-1, dimension)


def _limbs(value: int) -> list[int]:
    """Digits to base 2^LIMB; the last one carries the sign."""
    out = []
    for _ in range(3):
        value, digit = divmod(value, 1 << LIMB)
        out.append(digit)
    return [*out, value]


def _products(y: np.ndarray) -> list[list[int]]:
    """y' y in exact integers: floating-point products of halves that stay below 2^53, or Python's own integers."""
    top = int(np.abs(y).max(initial=0))
    if top < 1 << 20:  # 2^20 * 2^20 * 4096 rows < 2^53
        total = np.zeros((y.shape[1],) * 2, object)
        for k in range(0, len(y), 4096):
            part = y[k: k + 4096].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
        return total.tolist()
    wide = y.astype(object)
    return (wide.T @ wide).tolist()


def moments(vectors: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of y over all vectors, exact."""
    upper = [(i, j) for i in range(dimension) for j in range(i, dimension)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dimension, [[0] * dimension for _ in range(dimension)]
        for batch in batches:
            y = _matrix(batch.column(0), dimension)
            n += len(y)
            for k in range(0, len(y), 4096):  # halves: sums of 4096 longs below 2^31, or of their upper parts
                part = y[k: k + 4096]
                sums = [a + int(low) + (int(high) << 31) for a, low, high in zip(sums, (part & (2**31 - 1)).sum(0), (part >> 31).sum(0))]
            products = [[a + b for a, b in zip(r, s)] for r, s in zip(products, _products(y))]
        values = [n, *sums, *[products[i][j] for i, j in upper]]
        limbs = [_limbs(v) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *[pa.array([v[k] for v in limbs], pa.int64()) for k in range(4)]],
                                         names=["cell", "l0", "l1", "l2", "l3"])

    rows = vectors.select("v").mapInArrow(partial, "cell int, l0 long, l1 long, l2 long, l3 long").groupBy("cell").agg(
        *[F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(4)]).collect()
    values = {r["cell"]: sum(int(r[f"l{k}"]) << LIMB * k for k in range(4)) for r in rows}
    if not values:
        return 0, [0] * dimension, [[0] * dimension for _ in range(dimension)]
    products = [[0] * dimension for _ in range(dimension)]
    for k, (i, j) in enumerate(upper):
        products[i][j] = products[j][i] = values[1 + dimension + k]
    return values[0], [values[1 + i] for i in range(dimension)], products


# ---- the polynomial ------------------------------------------------------------------------------
def _is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every number below 3.4 * 10^14."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7, 11, 13, 17)):
        return False
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        x = pow(a, d, n)
        if n == a or x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below MODULUS_TOP, from the largest down, whose product has over `bits` bits."""
    out, product, n = [], 1, MODULUS_TOP - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest power first, of det(t I - matrix) modulo p; entries in 0..p-1."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(1)) % p  # the inverse step keeps the matrix similar
    polys = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for m in range(d):
        weights, t = np.zeros(m + 1, np.int64), 1
        for i in range(m, -1, -1):
            weights[i] = int(h[i, m]) * t % p
            t = t * int(h[i, i - 1]) % p
        polys[m + 1] = (np.roll(polys[m], 1) - (weights[:, None] * polys[: m + 1] % p).sum(0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, lowest power first, of det(t I - matrix) for a symmetric matrix without negative eigenvalues."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # the k-th elementary symmetric sum of d numbers >= 0 is at most C(d, k) (trace / d)^k
    bound = max(comb(d, k) * -(-trace**k // d**k) for k in range(d + 1))
    primes = primes_for(bound.bit_length() + 2)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                residues = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([polynomial_modulo(residues, p).tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    parts = min(len(primes), max(2, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts).mapInArrow(images, "p long, c array<long>").collect()
    product = 1
    for p in primes:
        product *= p
    totals = [0] * (d + 1)
    for r in rows:  # Chinese remaindering
        rest = product // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for k, c in enumerate(r["c"]):
            totals[k] += c * unit
    out = [t % product for t in totals]
    return [t - product if 2 * t > product else t for t in out]


# ---- roots ---------------------------------------------------------------------------------------
def roots_above(poly: list[int], numerator: int, bits: int) -> int:
    """How many roots, with multiplicity, lie above numerator / 2^bits, for a polynomial whose roots are all real:
    the changes of sign in the coefficients after a shift."""
    d = len(poly) - 1
    c = [v << bits * (d - k) for k, v in enumerate(poly)]  # in units of 2^-bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += numerator * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value_sign(poly: list[int], numerator: int, bits: int) -> int:
    value = 0
    for k in range(len(poly) - 1, -1, -1):
        value = value * numerator + (poly[k] << bits * (len(poly) - 1 - k))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> tuple[list[int], int]:
    """(numerators, bits): the `count` largest roots, with multiplicity, as numerators over 2^bits, each within 2^-ROOT_BITS
    of its size; roots of zero are 0 exactly."""
    d = len(poly) - 1
    zero = next(k for k, c in enumerate(poly) if c)  # multiplicity of the root 0
    poly = poly[zero:]
    out: list[int] = []
    bits = 0
    if len(poly) > 1:
        top = max(1, -poly[-2])  # the trace
        span = top.bit_length()
        bits = ROOT_BITS  # roots that are not zero may be far below one: then more bits
        while roots_above(poly, 1, bits - ROOT_BITS) < min(count, len(poly) - 1):
            bits += ROOT_BITS
        for k in range(min(count, len(poly) - 1)):
            low, high = 0, 1 << (span + bits)  # over k roots lie above low, at most k above high
            above_low, above_high, upper_sign = len(poly) - 1, 0, 0
            while high - low > max(1, high >> ROOT_BITS + 1):
                middle = (low + high) // 2
                # trailing zeros keep the shift's numbers short
                cut = max(0, (high - low).bit_length() - 3)
                middle = (middle >> cut) << cut if low < (middle >> cut) << cut < high else middle
                shift = min(bits, (middle & -middle).bit_length() - 1)
                if upper_sign:  # one root alone: the sign tells its side
                    sign = _value_sign(poly, middle >> shift, bits - shift)
                    low, high = (middle, middle) if not sign else (low, middle) if sign == upper_sign else (middle, high)
                    continue
                above = roots_above(poly, middle >> shift, bits - shift)
                if above > k:
                    low, above_low = middle, above
                else:
                    high, above_high = middle, above
                if above_low - above_high == 1:
                    upper_sign = _value_sign(poly, high, bits)
            out.append((low + high) // 2)
    return [*out, *[0] * (min(count, d) - len(out))], bits


# ---- components ----------------------------------------------------------------------------------
def _factored(matrix: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Lower and upper factors in fixed point with row exchanges; a pivot of zero counts as the smallest number."""
    a, d = [row[:] for row in matrix], len(matrix)
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
        a[k][k] = a[k][k] or 1
        head, top = a[k], a[k][k]
        for i in range(k + 1, d):
            row = a[i]
            if row[k]:
                f = (row[k] << WORK_BITS) // top
                row[k] = f
                for j in range(k + 1, d):
                    row[j] -= (f * head[j]) >> WORK_BITS
    return a, order


def _solved(a: list[list[int]], order: list[int], b: list[int]) -> list[int]:
    d = len(b)
    x = [b[i] for i in order]
    for i in range(d):
        x[i] -= sum(a[i][j] * x[j] for j in range(i)) >> WORK_BITS
    for i in range(d - 1, -1, -1):
        x[i] = ((x[i] << WORK_BITS) - sum(a[i][j] * x[j] for j in range(i + 1, d))) // a[i][i]
    return x


def _unit(x: list[int], others: list[list[int]]) -> list[int]:
    """x without its parts along `others`, of length one, in fixed point."""
    size = max(map(abs, x)).bit_length()
    x = [v << (WORK_BITS - size) if size < WORK_BITS else v >> (size - WORK_BITS) for v in x]
    for _ in range(2):
        for o in others:
            along = sum(a * b for a, b in zip(x, o)) >> WORK_BITS
            x = [a - (along * b >> WORK_BITS) for a, b in zip(x, o)]
    length = isqrt(sum(v * v for v in x))
    return [(v << WORK_BITS) // length for v in x] if length else x


def components_of(matrix: list[list[int]], roots: list[int], bits: int) -> np.ndarray:
    """A unit eigenvector per root, a row each, by inverse iteration in fixed point."""
    d = len(matrix)
    scale = max(1, sum(matrix[i][i] for i in range(d)))  # eigenvalues are at most the trace
    found: list[list[int]] = []
    for k, root in enumerate(roots):
        shifted = [[(v << WORK_BITS) // scale for v in row] for row in matrix]
        shift = (root << WORK_BITS) // (scale << bits)
        for i in range(d):
            shifted[i][i] -= shift
        a, order = _factored(shifted)
        # a start in no special direction, the same for all runs
        x = _unit([pow(3, 7 + 31 * k + i, 65_537) - 32_768 for i in range(d)], found)
        for _ in range(3):
            x = _unit(_solved(a, order, x), found)
        found.append(x)
    return np.array([[float(v) / 2.0**WORK_BITS for v in x] for x in found]).reshape(len(found), d)


class Whitening:
    """n, sums of y, components (rows), eigenvalues of the covariance, and the share of each in the trace."""

    def __init__(self, spark: SparkSession, n: int, sums: list[int], products: list[list[int]], count: int):
        d = len(sums)
        self.n, self.sums = n, sums
        scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        trace = sum(scatter[i][i] for i in range(d))
        roots, bits = largest_roots(characteristic_polynomial(spark, scatter), count) if d else ([], 0)
        self.components = components_of(scatter, roots, bits)
        self.eigenvalues = np.array([r / (n * n << bits) for r in roots], float)
        self.explained = np.array([r / (trace << bits) if trace else 0.0 for r in roots], float)


def fit(embeddings: DataFrame, count: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of all usable rows, and those rows."""
    vectors, dimension = prepared(embeddings)
    return Whitening(embeddings.sparkSession, *moments(vectors, dimension), count), vectors


def whitened(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Rows whose vector is null, empty, or holds a null, NaN or infinity are left out, and so are vectors of another
    dimension than most.  A deviation beyond a long is null.  A component of variance zero whitens to null, explains 0
    and has no part in identity_error, which is null where no component is left.  Repeated rows count as often as they
    stand there; a null vec_id stays.  Entries beyond 2^62 / 1024 count as that.
    """
    model, vectors = fit(embeddings, count)
    k, d, n = len(model.components), len(model.sums), model.n
    sums, kept = model.sums, model.eigenvalues > 0
    weights = np.where(kept[:, None], model.components / np.sqrt(np.where(kept, model.eigenvalues, 1.0))[:, None], 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_sum = max(map(abs, sums), default=0)
        for batch in batches:
            y = _matrix(batch.column(1), d)
            top = n * int(np.abs(y).max(initial=0)) + top_sum
            if top * top * d < 2**63:
                centred = n * y - np.array(sums, np.int64)
                deviation = [int(v) for v in (centred * centred).sum(1)]
            else:
                centred = n * y.astype(object) - np.array(sums, object)
                deviation = [v if v < 2**63 else None for v in map(int, (centred * centred).sum(1))]
            w = (centred / n).astype(np.float64) @ weights.T
            flat = pa.array(w.ravel(), mask=np.tile(~kept, len(y)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), values], names=["vec_id", "deviation", "w"])

    vec_id = vectors.schema["vec_id"].dataType.simpleString()
    out = vectors.mapInArrow(project, f"vec_id {vec_id}, deviation long, w array<double>") if d else vectors.select(
        "vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
    live = [c for c in range(k) if kept[c]]
    pairs = [(a, b) for i, a in enumerate(live) for b in live[i:]]
    error = None
    if pairs:
        got = out.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
