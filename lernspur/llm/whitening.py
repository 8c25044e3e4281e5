"""Whitening of embeddings: leading components of their covariance by contour integration.

The covariance is summed on Spark from centred vectors. Its eigenpairs are then
found interval by interval: counts of inertia (how many eigenvalues lie above a
shift, by Sylvester's law on the tridiagonal form) bracket the leading
eigenvalues and cut them into intervals; for each interval the solves of the
complex shifted covariance at the nodes of a circle around it filter a random
subspace, a Rayleigh-Ritz step takes the eigenpairs out of it, and this repeats
until the residuals are at rounding. An interval is done only if it gave as many
pairs as the counts of inertia at its ends ask for.

What comes to the driver is one covariance (dimensions x dimensions), never rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class WhitenConfig:
    components: int = 8
    #: Vectors become whole numbers: floor(scale * entry) + offset.
    scale: int = 1024
    offset: int = 100_000
    #: Points of the circle around an interval; those below the real line mirror those above.
    nodes: int = 32
    seed: int = 7
    #: The covariance of more dimensions is not taken to the driver.
    most_dims: int = 8192


#: Entries beyond this would not be exact as whole numbers in a double.
LARGEST = float(1 << 52)


# ---- eigenpairs of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal form (Householder)."""
    a = a.copy()
    n = len(a)
    off = np.zeros(max(0, n - 1))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(x))
        if norm == 0.0 or not x[1:].any():
            off[k] = x[0]
            continue
        alpha = -norm if x[0] >= 0 else norm
        off[k] = alpha
        x[0] -= alpha
        v = x / np.linalg.norm(x)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2.0 * (np.outer(v, w) + np.outer(w, v))
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of the shifted tridiagonal form."""
    diagonal, off = form
    tiny = np.finfo(float).tiny
    found, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = float(d) - shift - (float(off[i - 1]) ** 2 / pivot if i else 0.0)
        if pivot == 0.0:
            pivot = -tiny
        found += pivot > 0.0
    return found


def locate(form: tuple[np.ndarray, np.ndarray], most: int, low: float, high: float, width: float) -> list[float]:
    """The ``most`` largest eigenvalues, falling, each to within ``width``, by bisection on the counts."""
    out = []
    for k in range(1, most + 1):
        a, b = low, out[-1] + width if out else high
        while b - a > width:
            middle = 0.5 * (a + b)
            if middle in (a, b):
                break
            a, b = (middle, b) if count_above(form, middle) >= k else (a, middle)
        out.append(0.5 * (a + b))
    return out


def intervals(values: list[float], wanted: int, least: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) around the leading ``wanted`` of the falling ``values``, cut in wide gaps only.

    A run of eigenvalues closer than ``least`` is never cut, so the last interval may hold more than was asked for.
    ``values`` end with the first eigenvalue beyond, if there is one.
    """
    end = wanted
    while end < len(values) and values[end - 1] - values[end] <= least:
        end += 1
    starts = [0]
    for i in range(1, end):
        gap = values[i - 1] - values[i]
        if gap > least and gap > 0.5 * (values[0] - values[end - 1]) / max(1, end - 1):
            starts.append(i)
    out = []
    for a, b in zip(starts, [*starts[1:], end], strict=True):
        span = values[a] - values[b - 1]
        up = 0.5 * (values[a - 1] - values[a]) if a else np.inf
        down = 0.5 * (values[b - 1] - values[b]) if b < len(values) else np.inf
        room = max(span, min(up, down)) if np.isfinite(min(up, down)) else max(span, 0.5 * abs(values[a]), least)
        out.append((values[b - 1] - min(down, room), values[a] + min(up, room), b - a))
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int, config: WhitenConfig) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of ``v`` between ``low`` and ``high``, falling, and their unit vectors as columns; there must be ``inside`` of them."""
    n, norm = len(v), float(np.linalg.norm(v, 2))
    rng = np.random.default_rng(config.seed)
    centre, radius = 0.5 * (low + high), 0.5 * (high - low)
    turns = np.exp(1j * (np.arange(config.nodes // 2) + 0.5) * 2.0 * np.pi / config.nodes)
    size = min(n, max(inside + 8, 2 * inside))
    while True:
        basis, best = rng.standard_normal((n, size)), np.inf
        for _ in range(12):
            projected = np.zeros((n, size))
            for turn in turns:
                shifted = -v.astype(complex)
                shifted[np.diag_indices(n)] += centre + radius * turn
                projected += (2.0 * radius / config.nodes) * np.real(turn * np.linalg.solve(shifted, basis))
            q, _ = np.linalg.qr(projected if size < n else rng.standard_normal((n, n)))
            ritz, turned = np.linalg.eigh(q.T @ v @ q)
            basis = q @ turned
            within = np.flatnonzero((ritz > low) & (ritz < high))
            if len(within) != inside:
                continue
            vectors, values = basis[:, within], ritz[within]
            worst = float(np.abs(v @ vectors - vectors * values).max())
            if worst <= 4 * np.finfo(float).eps * norm or 0.5 * best <= worst <= 1e-11 * norm:
                order = np.argsort(-values, kind="stable")
                return values[order], vectors[:, order]
            best = min(best, worst)
        # many eigenvalues just outside: a wider subspace leaves them behind
        if size == n:
            raise ArithmeticError(f"no {inside} eigenpairs between {low} and {high}")
        size = min(n, 2 * size)


def leading_components(v: np.ndarray, config: WhitenConfig = WhitenConfig()) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a covariance, falling, and their unit vectors as rows, each with its entry of largest size positive.

    Values not above rounding (dimensions x 2.2e-16 x the largest) are no components: a covariance of lower rank has fewer.
    """
    n = len(v)
    largest = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    if largest == 0.0:
        return np.zeros(0), np.zeros((0, n))
    form = tridiagonal(v)
    top = locate(form, 1, 0.0, largest * 1.001, 1e-9 * largest)[0]
    wanted = min(config.components, count_above(form, n * np.finfo(float).eps * top))
    # one more than asked for, and as many more as hang together with the last
    width, least, known = 1e-10 * top, 1e-8 * top, min(n, wanted + 1)
    values = locate(form, known, -top, largest * 1.001, width)
    while known < n and not any(a - b > least for a, b in zip(values[wanted - 1 :], values[wanted:], strict=False)):
        known = min(n, 2 * known)
        values = locate(form, known, -top, largest * 1.001, width)
    found = []
    for low, high, inside in intervals(values, wanted, least):
        if count_above(form, low) - count_above(form, high) != inside:
            raise ArithmeticError(f"the counts of inertia at {low} and {high} do not leave {inside} eigenvalues")
        found.append(feast(v, low, high, inside, config))
    eigenvalues = np.concatenate([x for x, _ in found])[:wanted]
    vectors = np.concatenate([y for _, y in found], axis=1)[:, :wanted].T
    signs = np.sign(vectors[np.arange(wanted), np.argmax(np.abs(vectors), axis=1)])
    return eigenvalues, vectors * signs[:, None]


# ---- the passes over the vectors


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about four million entries."""
    most = max(1, (1 << 22) // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _numbers(batch: pa.RecordBatch, dims: int, config: WhitenConfig) -> np.ndarray:
    """The vectors of a batch, its last column, as whole numbers."""
    flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(config.scale * flat.reshape(batch.num_rows, dims))).astype(np.int64) + config.offset


def usable(df: DataFrame, vector: str, config: WhitenConfig) -> tuple[DataFrame, int]:
    """The rows of the fit list, and their number of dimensions: the commonest length (the longer on a tie) of the vectors that are neither null nor hold a null or non-finite entry.

    Vectors of another length, empty ones and those with entries too large to be exact whole numbers are left out.
    """
    bound = F.lit(LARGEST / config.scale)
    good = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < bound)), F.lit(False)))
    common = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = common["d"] if common else 0
    if dims > config.most_dims:
        raise ValueError(f"{dims} dimensions; a covariance of more than {config.most_dims} is not taken to the driver")
    return good.where(F.size(vector) == dims), dims


def _sums(fit: DataFrame, dims: int, config: WhitenConfig) -> tuple[int, list[int]]:
    """Number of vectors and the exact sums of their entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in _slices(batches, dims):
            x = _numbers(batch, dims, config)
            n += len(x)
            for at in range(0, len(x), 512):  # 512 numbers under 2 ** 53 stay within 64 bits
                total = total + x[at : at + 512].sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([decimal.Decimal(int(t)) for t in (n, *total)], pa.decimal128(38, 0))], names=["i", "total"])

    rows = fit.mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    sums = {r["i"]: int(r["total"]) for r in rows}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(dims)]


def _products(fit: DataFrame, dims: int, width: int, of: Callable[[np.ndarray], np.ndarray], config: WhitenConfig) -> np.ndarray:
    """Sum of the outer products of ``of(vectors)`` with themselves."""
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in _slices(batches, dims):
            c = of(_numbers(batch, dims, config))
            total += c.T @ c
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "total"])

    out = np.zeros((width, width))
    for r in fit.mapInArrow(add, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"]
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n x - S) squared: with S = n m + r it is n n sum(u u) - 2 n sum(u r) + sum(r r) for u = x - m."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    u = x - whole
    far = int(np.abs(u).max(initial=0))
    if (far + 1) * max(far, *rest, 1) * len(rest) < 1 << 62:
        r = np.array(rest, dtype=np.int64)
        squares, mixed = (u * u).sum(axis=1), (u * r).sum(axis=1)
    else:
        u, r = u.astype(object), np.array(rest, dtype=object)
        squares, mixed = (u * u).sum(axis=1), (u * r).sum(axis=1)
    own = sum(r * r for r in rest)
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed, strict=True)]


def whiten(df: DataFrame, vector: str = "embedding", config: WhitenConfig = WhitenConfig()) -> DataFrame:
    """``row`` (all input columns but the vector), n, deviation (exact), whitened and explained (arrays, one entry a component) and identity_error of every usable vector.

    Left out are null vectors, those with a null, NaN or infinite entry, and what ``usable`` names besides. Equal
    vectors and repeated rows count each. All vectors are read whole, four times in all. Where the covariance has fewer
    directions than components are asked for, the arrays are shorter, and empty for one vector or equal vectors. An
    empty table, or one without a usable vector, gives an empty result. ``deviation`` is null where it has more than 38
    digits. Columns may have any names; the vector's may be of float or double.
    """
    spark = df.sparkSession
    fit, dims = usable(df, vector, config)
    only = fit.select(vector)
    n, sums = _sums(only, dims, config) if dims else (0, [])
    mean = np.array([s / n for s in sums]) if n else np.zeros(dims)
    covariance = _products(only, dims, dims, lambda x: x - mean, config) / max(n, 1)
    values, vectors = leading_components(covariance, config)
    turn = (vectors / np.sqrt(values)[:, None]).T
    # the sums are whole numbers, so what rounding the mean leaves of the centred vectors' mean is known
    left = np.array([float(Fraction(s, n) - Fraction(m)) for s, m in zip(sums, mean.tolist(), strict=True)]) if n else np.zeros(dims)
    middle = left @ turn
    k = len(values)
    spread = _products(only, dims, k, lambda x: (x - mean) @ turn - middle, config) / max(n, 1) if k else np.zeros((0, 0))
    error = float(np.abs(spread - np.eye(k)).max()) if k else 0.0
    explained = [float(e) for e in values / np.trace(covariance)] if k else []
    shared = spark.sparkContext.broadcast((mean, turn, n, sums))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn, n, sums = shared.value
        for batch in _slices(batches, dims):
            x = _numbers(batch, dims, config)
            y = (x - mean) @ turn
            exact = [decimal.Decimal(d) if d < 10**38 else None for d in _deviations(x, n, sums)]
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.decimal128(38, 0)), white], names=["row", "deviation", "whitened"])

    others = [F.col(f"`{c}`") for c in df.columns if c != vector]
    carried = fit.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), F.col(vector).alias("vector"))
    kind = T.StructType([carried.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    done = carried.mapInArrow(apply, kind)
    return done.select("row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))

