"""Operator 13: whitening of embeddings by tall-skinny QR (TSQR) and the singular values of its last factor."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import cut, small_batches

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact whole number that sums can hold; such vectors are left out like non-finite ones.
TOO_LARGE = float(1 << 40)
#: Factors that one step of the tree merges.
FAN_IN = 16


@dataclass(frozen=True)
class Basis:
    """What fit() learns: number of vectors, exact sums, eigenvalues (falling), unit eigenvectors (columns), the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(column: str) -> Column:
    """True for a vector that is not null or empty and has finite entries only."""
    good = F.forall(column, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < TOO_LARGE), F.lit(False)))
    return F.col(column).isNotNull() & (F.size(column) > 0) & good


def whole_numbers(batch: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    """Column k (lists of `width` numbers each) as a matrix of whole numbers."""
    entries = batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, width) + SHIFT


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x minus the mean: whole parts are subtracted exactly, the fraction of the mean is the only rounding."""
    low = np.array([s // n for s in sums], np.int64)
    return (x - low).astype(np.float64) - np.array([s % n / n for s in sums])


def exact_sums(rows: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors (column v) and the exact sum of each dimension; the driver sees one row a dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, object)
        for batch in batches:
            x = whole_numbers(batch, 0, width)
            for a in range(0, len(x), 1000):  # so many stay below 64 bits
                sums += x[a : a + 1000].sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())], ["dim", "sum", "n"])

    found = rows.select("v").mapInArrow(work, "dim int, sum decimal(38,0), n long").groupBy("dim").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r["dim"])
    return (found[0]["n"], tuple(int(r["sum"]) for r in found)) if found else (0, ())


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def factor(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the QR decomposition of all centred vectors (column v): one of each partition, merged FAN_IN at a time until one is left.

    No covariance is formed: that would square the condition number. A factor has as many rows and columns as a vector has dimensions, at most.
    """
    width = len(sums)
    block = max(4 * width, 1024)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.zeros((0, width)), [], 0
        for batch in batches:
            x = centred(whole_numbers(batch, 0, width), n, sums)
            held.append(x)
            size += len(x)
            if size >= block:
                r, held, size = _factor([r, *held]), [], 0
        r = _factor([r, *held]) if held else r
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b).reshape(-1, width) for b in group.sort_values("part")["r"]]
        return pd.DataFrame({"part": [int(group["part"].min()) // FAN_IN], "r": [_factor(parts).tobytes()]})

    factors = cut(rows.select("v").mapInArrow(work, "part long, r binary"))
    parts = factors.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        factors = cut(factors.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(merged, "part long, r binary"))
        parts = -(-parts // FAN_IN)
    return np.frombuffer(factors.first()["r"]).reshape(-1, width)


def vectors_of(rows: DataFrame, vector_column: str) -> tuple[DataFrame, int]:
    """Usable rows of the commonest length (of equally common ones the longest), their vector as v; and that length, 0 if there is none."""
    kind = "array<float>" if "float" in rows.schema[vector_column].dataType.simpleString() else "array<double>"
    good = rows.where(usable(vector_column)).withColumn("v", F.col(vector_column).cast(kind))
    length = good.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = length["width"] if length else 0
    return good.where(F.size("v") == width), width


def fit(rows: DataFrame, width: int, components: int = 8) -> Basis | None:
    """The first eigenvectors of the covariance of all vectors (column v, `width` numbers each); None without vectors. Directions without
    variance, to double precision, are no components."""
    n, sums = exact_sums(rows, width) if width else (0, ())
    if not n:
        return None
    _, s, vt = np.linalg.svd(factor(rows, n, sums))
    rank = int((s > s[0] * max(width, len(s)) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    k = min(components, rank)
    values = s * s / n
    return Basis(n, sums, values[:k], vt[:k].T, math.fsum(values.tolist()))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum of (n * x - S) ** 2 over dimensions, exact; None where a long can't hold it."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        off = n * x - np.array(sums, np.int64)
        if (int(np.abs(off).max(initial=0)) ** 2) * len(sums) < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]


def identity_error(rows: DataFrame, basis: Basis) -> float:
    """The largest entry, by size, of the whitened vectors' covariance minus the identity."""
    k, width, scaled = len(basis.values), len(basis.sums), basis.vectors / np.sqrt(basis.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = centred(whole_numbers(batch, 0, width), basis.n, basis.sums) @ scaled
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["at", "x"])

    cov = np.zeros(k * k)
    for r in rows.select("v").mapInArrow(work, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # k * k rows
        cov[r["at"]] = r["x"] / basis.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each usable vector and component: id_column, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or that have a null, non-finite or too large entry (TOO_LARGE), are left out, and so are those of another length than
    the commonest. Ids only travel along: they may be null or repeat. Where the vectors vary in fewer directions than `components`, there are as many
    components as directions; equal vectors, a single one or none give no rows. A deviation beyond a long is null.

    Exact sums centre the vectors; each partition's QR factor is merged in a tree; the right singular vectors of the last factor are the
    components. What leaves a task is a factor, never a row; the driver sees the last factor and sums by dimension.
    """
    small_batches(rows.sparkSession)
    good, width = vectors_of(rows, vector_column)
    basis = fit(good, width, components)
    schema = f"{id_column} {rows.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if basis is None or not len(basis.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(good, basis)
    k, scaled = len(basis.values), basis.vectors / np.sqrt(basis.values)
    explained = basis.values / basis.trace
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch, 1, width)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            deviation = pa.array(deviations(x, basis.n, basis.sums), pa.int64()).take(pa.array(each))
            w = centred(x, basis.n, basis.sums) @ scaled
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, basis.n)), deviation]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)

    return good.select(id_column, "v").mapInArrow(work, schema)
