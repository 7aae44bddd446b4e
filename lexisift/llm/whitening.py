"""Whitening of vectors by the leading components of their covariance.

The covariance is never made.  Matrix-free block Lanczos: one pass over the rows multiplies a block of
directions by the centred XᵀX (every task sums its rows' share, the shares meet in one aggregation of
dimensions x block numbers), and the driver, which holds directions only, orthogonalises the result
against all earlier directions, twice.  A block that breaks down (fewer new directions than columns)
starts again in random directions orthogonal to all others; a basis of MAX_BASIS directions starts
again from its best ones.  It ends when the residuals of the wanted components are TOLERANCE of the
largest eigenvalue, or when the directions span the whole space.

The trace is the sum of the rows' deviations, which are exact integers; so a component's share needs
no other eigenvalue.

Defined cases: rows whose vector is null or empty, holds a null or non-finite entry, or an entry c with
|1024 c| of 2^53 or more (no exact integer), are left out; of several lengths of vectors the most
common one stays (of equally common ones the longest); repeated rows count each on their own; a null
vec_id stays null; components of no variance are not given, so there are fewer than wanted where the
rows span fewer directions, and none for equal rows or a single one; an empty table gives no rows;
other columns are ignored.  Components of equal variance are any orthonormal ones of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS, BLOCK = 8, 8
TOLERANCE, MAX_BASIS, MAX_PASSES = 1e-13, 512, 400
#: Eigenvalues below this share of the largest are no variance.
NOTHING = 1e-12
#: Rows multiplied at once.
ROWS = 4096


class Fit(NamedTuple):
    """What a fit leaves: small arrays, whose size depends on the dimensions only."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    passes: int


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, x: the vectors that can be used, each entry as floor(1024 c) + 100000."""
    c = F.col("embedding").cast("array<double>")
    usable = (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v) * SCALE < float(1 << 53), F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), x).alias("x")).where("x is not null")


def blocks(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """A list column as int64 matrices of at most ROWS rows."""
    for lo in range(0, len(column), ROWS):
        part = column.slice(lo, ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(part), d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n; (n x - S) is exact as long as it fits, and is divided once."""
    if float(np.abs(x).max(initial=0)) * n < float(1 << 62):
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2, exact."""
    if float(np.abs(x).max(initial=0)) * n < float(1 << 62):
        t = n * x - sums.astype(np.int64)
        if float(np.abs(t).max(initial=0)) ** 2 * x.shape[1] < float(1 << 62):
            return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38, 0))
    t = n * x.astype(object) - sums
    return pa.array([Decimal(int(v)) for v in (t * t).sum(axis=1)], pa.decimal128(38, 0))


def _summed(rows: DataFrame, share: Callable[[np.ndarray], np.ndarray], d: int, size: int) -> np.ndarray:
    """The sum over all blocks of rows of share(block), an array of `size` numbers: one number array leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size), False
        for batch in batches:
            for x in blocks(batch.column(0), d):
                total += share(x)
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            for x in blocks(batch.column(0), d):
                n += len(x)
                total += (x if float(np.abs(x).max()) * ROWS < float(1 << 62) else x.astype(object)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([Decimal(int(v)) for v in [*total, n]], pa.decimal128(38, 0))], names=["at", "v"])

    got = rows.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return int(got[-1]["v"]), np.array([int(r["v"]) for r in got[:-1]], dtype=object)


def orthonormal(new: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Directions of `new` orthogonal to the basis and to each other; lost ones are replaced by random ones while there is room."""
    d, out = len(new), basis
    for k in range(new.shape[1]):
        if out.shape[1] == d:
            break
        v, least = new[:, k], scale * 1e-10
        for _ in range(8):
            length = np.linalg.norm(v)
            if length > least:
                v = v / length
                for _ in range(2):
                    v = v - out @ (out.T @ v)
                if (left := np.linalg.norm(v)) * length > least and left > 1e-8:
                    v = v / left
                    v = v - out @ (out.T @ v)
                    out = np.column_stack([out, v / np.linalg.norm(v)])
                    break
            v, least = rng.standard_normal(d), 0.0
    return out[:, basis.shape[1] :]


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, size: int = BLOCK, tolerance: float = TOLERANCE, most: int = MAX_BASIS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues of a symmetric operator, their unit vectors, and how often it was applied to a block.

    A block has as many columns as are wanted, at least, so that equal eigenvalues are all found."""
    rng, wanted = np.random.default_rng(seed), min(wanted, d)
    size = min(max(size, wanted, 1), d)
    most = max(most, 4 * max(size, wanted))
    q, aq, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    block = orthonormal(rng.standard_normal((d, size)), q, 0.0, rng)
    while True:
        w = multiply(block)
        passes += 1
        q, aq = np.column_stack([q, block]), np.column_stack([aq, w])
        h = q.T @ aq
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        best = y[:, :wanted]
        residual = np.linalg.norm(aq @ best - (q @ best) * values[:wanted], axis=0)
        whole = q.shape[1] == d
        if whole or (q.shape[1] >= wanted + size and residual.max() <= tolerance * max(values[0], 0.0)) or passes >= MAX_PASSES:
            vectors = q @ best
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0), passes
        if q.shape[1] + size > most:
            keep = y[:, : most // 2]
            rest = aq @ best - (q @ best) * values[:wanted]
            q, aq = q @ keep, aq @ keep
            w = np.column_stack([rest, w])[:, :size]
        block = orthonormal(w, q, max(values[0], 0.0), rng)


def fit(x: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Fit | None:
    """The leading components over all rows of `x` (array<long>, one length), or None without rows."""
    d = x.select(F.size("x").alias("d")).groupBy().agg(F.max("d").alias("d")).first()["d"]
    if d is None:
        return None
    n, exact = _exact_sums(x, d)

    def multiply(v: np.ndarray) -> np.ndarray:
        def share(rows: np.ndarray) -> np.ndarray:
            c = centred(rows, n, exact)
            return (c.T @ (c @ v)).ravel()

        return _summed(x, share, d, v.size).reshape(v.shape) / n

    values, vectors, passes = block_lanczos(multiply, d, components, block)
    has = values > NOTHING * max(float(values[0]), 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[has], vectors[:, has]
    schema = "v decimal(38,0)"

    def deviate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in blocks(batch.column(0), d):
                yield pa.RecordBatch.from_arrays([deviations(rows, n, exact)], names=["v"])

    total = x.select("x").mapInArrow(deviate, schema).agg(F.sum("v")).first()[0]
    trace = Decimal(total) / (Decimal(n) ** 3)
    return Fit(n, exact, values, vectors, np.array([float(Decimal(float(e)) / trace) for e in values]), passes)


def project(x: DataFrame, model: Fit) -> DataFrame:
    """vec_id, deviation (decimal), whitened (array<double>, a number for each component)."""
    n, sums, d = model.n, model.sums, len(model.sums)
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in blocks(batch.column(1), d):
                w = centred(rows, n, sums) @ scaled
                offs = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), deviations(rows, n, sums), pa.ListArray.from_arrays(offs, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])
                at += len(rows)

    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(x: DataFrame, model: Fit) -> float:
    """The largest entry, by size, of the whitened rows' covariance minus the identity."""
    n, k = model.n, len(model.values)
    scaled = model.vectors / np.sqrt(model.values)

    def share(rows: np.ndarray) -> np.ndarray:
        w = centred(rows, n, model.sums) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(x, share, len(model.sums), k + k * k)
    mean = got[:k] / n
    return float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """rows (vec_id, embedding) to vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    spark = rows.sparkSession
    x = staged(integers(rows), "whitening")
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        one = staged(x.where(F.size("x") == lengths[0]["d"]), "whitening")
        drop_staged(x)
        x = one
    model = fit(x, components, block)
    if model is None or len(model.values) == 0:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(x, model)
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    out = project(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds (it grows with the square of the rows) is null here; the operator has it whole."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))
