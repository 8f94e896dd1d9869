"""Embedding whitening from an exact bit-sliced scatter.

Entries become whole numbers. A task shifts each dimension of a batch by its smallest entry, so that none is negative,
and packs every bit plane of a dimension across the rows into 64-bit words. The cross-product of two dimensions is then
a sum of popcounts of ANDed planes, weighted by powers of two: exact, without one multiplication of entries. A constant
dimension of ones rides along, so sums and the number of rows come out of the same popcounts. Tasks emit one row a pair
of dimensions, Spark adds them up, and the driver centres a square of Python integers before its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices, write_scratch

SCALE, OFFSET = 1024, 100_000
#: Rows whose planes are packed at once.
BATCH = 4096
#: Cross-products travel as three limbs of so many bits, which add up without overflow.
LIMB = 40
_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Whitening:
    """What the fit knows: ``n`` rows, sums ``total`` per dimension, unit ``components`` (one a row, by falling
    ``values``) and the ``trace`` of the covariance, which belongs to the scaled whole numbers."""

    n: int
    total: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: str | Column) -> Column:
    """Whether a vector has entries, none of them null, NaN or infinite."""
    entries = F.col(vector) if isinstance(vector, str) else vector
    far = float("inf")
    # In doubles: an array of another numeric type is taken as well.
    fine = F.forall(entries.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (c < far) & (c > -far))
    return F.coalesce(fine & (F.size(entries) > 0), F.lit(False))


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """``floor(1024 * c) + 100000`` as 64-bit numbers; what goes beyond them stops at their ends."""
    scaled = np.floor(entries * SCALE)
    inside = np.abs(scaled) < 2.0**62
    out = np.where(inside, scaled, 0).astype(np.int64) + OFFSET
    return np.where(inside, out, np.where(scaled > 0, _LONG.max, _LONG.min))


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of unsigned numbers (rows, dimensions) that are not all zero: words (planes, words of 64 rows), and
    the dimension and the bit of each."""
    rows, d = shifted.shape
    widths = [int(x).bit_length() for x in shifted.max(0)]
    owner = np.repeat(np.arange(d), widths)
    bit = np.concatenate([np.arange(w) for w in widths]) if d else np.zeros(0, np.int64)
    padded = -rows % 64
    bits, columns = np.zeros((len(owner), rows + padded), np.uint8), np.ascontiguousarray(shifted.T)
    for p, (dim, b) in enumerate(zip(owner.tolist(), bit.tolist(), strict=True)):
        bits[p, :rows] = (columns[dim] >> np.uint64(b)) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), owner, bit


def scatter(numbers: np.ndarray) -> list[list[int]]:
    """Upper triangle of the exact cross-products of the columns, the first of which is a constant one: entry (0, 0) is
    the number of rows, (0, j) the sum of a column."""
    rows, d = numbers.shape
    low = [int(x) for x in numbers.min(0)]
    shifted = numbers.astype(np.uint64) - np.array(low, np.int64).astype(np.uint64)  # modulo 2^64: right for any range
    words, owner, bit = planes(np.concatenate([np.ones((rows, 1), np.uint64), shifted], 1))
    first = np.searchsorted(owner, np.arange(d + 1))
    products = [[0] * (d + 1) for _ in range(d + 1)]
    small = 2 * (int(bit.max()) + 1) + rows.bit_length() < 63
    for p in range(len(owner)):
        i = int(owner[p])
        after = slice(int(first[i]), None)
        common = np.bitwise_count(words[p] & words[after]).sum(1, dtype=np.int64)
        if small:
            weighed = np.zeros(d + 1, np.int64)
            np.add.at(weighed, owner[after], common << bit[after])
            sums = weighed.tolist()
        else:
            sums = [0] * (d + 1)
            for j, b, n in zip(owner[after].tolist(), bit[after].tolist(), common.tolist(), strict=True):
                sums[j] += n << b
        for j in range(i, d + 1):
            products[i][j] += sums[j] << int(bit[p])
    # Back from shifted numbers: (u + a)(v + b) = uv + a v + b u + ab.
    sums, shift = products[0][:], [0, *low]
    for i in range(d + 1):
        for j in range(i, d + 1):
            products[i][j] += shift[i] * sums[j] + shift[j] * sums[i] + rows * shift[i] * shift[j]
    return products


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _dimension(vectors: DataFrame) -> int | None:
    """The length that most vectors have, of equally frequent ones the greatest; null without vectors."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return found and found["d"]


def _entries(embeddings: DataFrame, vector: str) -> DataFrame:
    return embeddings.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))


def fit(embeddings: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Eigenvectors of the covariance of all usable vectors, as whole numbers; null if there are none.

    Vectors with null or non-finite entries, null and empty ones are left out, and so are those of another length than
    most: they have no place in the space. Repeated rows count as often as they stand there; other columns are ignored.
    """
    rows = _entries(embeddings, vector)
    d = _dimension(rows)
    if d is None:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[list[int]] | None = None
        for batch in batches:
            for part in slices([batch], BATCH):
                found = scatter(whole_numbers(_vectors(part.column("v"), d)))
                total = found if total is None else [[a + b for a, b in zip(x, y, strict=True)]
                                                     for x, y in zip(total, found, strict=True)]
        if total is not None:
            place = [(i, j, total[i][j]) for i in range(d + 1) for j in range(i, d + 1)]
            low = (1 << LIMB) - 1
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in place], pa.int32()), pa.array([j for _, j, _ in place], pa.int32()),
                pa.array([x & low for _, _, x in place], pa.int64()),
                pa.array([x >> LIMB & low for _, _, x in place], pa.int64()),
                pa.array([str(x >> 2 * LIMB) for _, _, x in place])], ["i", "j", "low", "mid", "high"])

    parts = rows.where(F.size("v") == d).mapInArrow(add, "i int, j int, low long, mid long, high string")
    sums = parts.groupBy("i", "j").agg(F.sum("low").alias("low"), F.sum("mid").alias("mid"),
                                       F.sum(F.col("high").cast("decimal(38,0)")).alias("high"))
    # A row a pair of dimensions, whatever the number of vectors.
    product = {(r["i"], r["j"]): (int(r["high"]) << 2 * LIMB) + (r["mid"] << LIMB) + r["low"] for r in sums.collect()}
    n, total = product[0, 0], [product[0, j] for j in range(1, d + 1)]
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * product[i + 1, j + 1] - total[i] * total[j]) / (n * n)
    values, columns = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")
    return Whitening(n, tuple(total), columns.T[falling].copy(), values[falling], float(np.trace(covariance)))


def _centred(numbers: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: in 64 bits if they hold it, else as Python integers."""
    most = max(abs(int(numbers.min())), abs(int(numbers.max()))) if numbers.size else 0
    if n * most + max(abs(int(x)) for x in total) < 2**62:
        return numbers * n - total.astype(np.int64)
    return numbers.astype(object) * n - total


def _deviation(centred: np.ndarray) -> list[int | None]:
    top = int(np.abs(centred).max()) if centred.size else 0
    if top * top * centred.shape[1] < 2**62:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    sums = [sum(int(x) ** 2 for x in row) for row in centred]
    return [x if x <= _LONG.max else None for x in sums]


def transform(embeddings: DataFrame, fitted: Whitening, most: int = 8, key: str = "vec_id",
              vector: str = "embedding") -> DataFrame:
    """``key, deviation, whitened`` for each usable vector of the fitted length: ``whitened`` has a double for each of the
    first ``most`` components, null where the component's variance is zero within rounding; ``deviation`` is the sum
    of ``(n * x - S)^2``, null beyond 64 bits. Repeated rows stay rows, a null key stays null."""
    d, n = len(fitted.total), fitted.n
    total = np.array(fitted.total, object)
    chosen = fitted.components[:most]
    values = fitted.values[:most]
    flat = values <= max(fitted.values[0], 0.0) * d * np.finfo(float).eps
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, values)))
    rows = embeddings.where(usable(vector)).select(key, F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            centred = _centred(whole_numbers(_vectors(batch.column("v"), d)), n, total)
            white = (centred / n).astype(np.float64) @ chosen.T / scale
            mask = np.tile(flat, len(white))
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * len(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviation(centred), pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(white.ravel(), mask=mask))], [key, "deviation", "whitened"])

    kind = embeddings.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened``, less the identity, over components that have a variance.

    Means first, then products of what is centred: two aggregations of a few numbers. Null without rows or variance.
    """
    of = [F.col("whitened")[k] for k in range(components)]
    means = white.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(of))).first()
    alive = [k for k in range(components) if means[k] is not None]
    if not alive:
        return None
    centred = {k: of[k] - F.lit(means[k]) for k in alive}
    pairs = [(k, m) for k in alive for m in alive if k <= m]
    found = white.agg(*(F.avg(centred[k] * centred[m]).alias(f"c{k}_{m}") for k, m in pairs)).first()
    return max(abs(found[p] - (k == m)) for p, (k, m) in enumerate(pairs))


def whiten(embeddings: DataFrame, most: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and each of
    the first ``most`` components (as many as there are dimensions, if fewer), numbered from 1 by falling variance.

    ``explained`` is null if nothing varies. Without usable vectors the result is empty.
    """
    kind = embeddings.schema[key].dataType.simpleString()
    fitted = fit(embeddings, vector)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame(
            [], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    count = min(most, len(fitted.values))
    white = write_scratch(transform(embeddings, fitted, count, key, vector), "whitened")
    error = identity_error(white, count)
    share = [float(x) / fitted.trace if fitted.trace > 0 else None for x in fitted.values[:count]]
    return white.select(key, "deviation", F.posexplode("whitened").alias("place", "value")).select(
        key, (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"),
        F.element_at(F.array(*(F.lit(x).cast("double") for x in share)), F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
