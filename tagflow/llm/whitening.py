"""Embedding whitening: projections on the leading eigenvectors of the covariance, scaled to unit variance.

Three passes of partial sums over the rows fit it: sums by dimension (exact integers), the centred products
(a triangle of dimension x dimension numbers a task, added in a shuffle), and the products of the whitened
rows, whose distance from the identity is measured, not assumed. The driver gets sums alone, at most
dimension^2 / 2 of them, and finds the leading eigenpairs by ``spectrum``. The last pass writes each row's
components. No row leaves its task before that.

Entries become x = floor(64 c) + 1000000. They are centred without losing digits: the whole part of the mean is
taken off as an integer and the rest, which is below 1, as a double.

Defined cases: vectors that are null or hold null or non-finite entries are left out; repeated rows and rows
with a null id count each; shorter vectors are filled with zeros; components whose eigenvalue is no more than
rounding (EPS times the trace) have no whitened form and give no rows, so equal vectors alone give none; an
empty table gives none; a deviation beyond 2^63 is null; entries of 2^40 or more are an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import pick, slices, workers_ready
from .spectrum import leading

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
EPS, LARGEST = 1e-13, 2.0 ** 40
#: Numbers of a slice of rows that a task holds as a matrix.
NUMBERS = 1 << 18


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of floor(64 c), without the offset
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # as columns
    trace: float
    identity_error: float = float("nan")


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) of a list column, short rows filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) >= LARGEST:
        raise ValueError("an entry is too large to whiten")
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.arange(dim)[None] < lengths[:, None]] = flat.astype(np.int64)
    return out


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    base = np.array([s // n for s in sums], dtype=np.int64)
    return (x - base) - np.array([(s - n * (s // n)) / n for s in sums])


def added_up(vectors: DataFrame, dim: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over rows of r r' for r = rows_of(floor(64 c)): each task adds its rows, a shuffle adds the tasks."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in slices(batches, max(1, NUMBERS // dim)):
            if batch.num_rows:
                r = rows_of(whole(batch.column("v"), dim))
                total += r.T @ r
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])],
                                             ["i", "j", "part"])

    out = np.zeros((width, width))
    sums = vectors.select("v").mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    for r in sums.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["part"]
    return out


def sums_of(vectors: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """(rows, sums by dimension of floor(64 c)), exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in slices(batches, max(1, NUMBERS // dim)):
            n += batch.num_rows
            total += whole(batch.column("v"), dim).sum(axis=0).astype(object) if batch.num_rows else 0
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(int(x)) for x in (n, *total)], pa.decimal128(38, 0))], ["i", "part"])

    rows = vectors.select("v").mapInArrow(run, "i int, part decimal(38,0)").groupBy("i").agg(F.sum("part").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(dim))


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    rows = pick(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    return rows.where(usable(F.col("v")))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows: as prepared. None if there are none."""
    workers_ready(rows.sparkSession)
    dim = rows.agg(F.max(F.size("v"))).collect()[0][0]
    if dim is None:
        return None
    n, sums = sums_of(rows, dim)
    covariance = added_up(rows, dim, lambda x: centred(x, n, sums), dim) / n
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    real = values > EPS * max(trace, 1e-300) * max(dim, 1)
    fitted = Whitening(n, sums, values[real], vectors[:, real], trace)
    if not real.any():
        return fitted
    k = int(real.sum())
    second = added_up(rows, dim, lambda x: whitened(x, fitted), k) / n
    mean = second - np.eye(k)
    return Whitening(n, sums, fitted.values, fitted.vectors, trace, float(np.abs(mean).max()))


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.vectors / np.sqrt(model.values))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2, exact; null beyond 64 bits."""
    sums = np.array(model.sums, dtype=object)
    away = np.abs(centred(x, model.n, model.sums)).max(initial=0) * model.n
    if away ** 2 * max(x.shape[1], 1) < 2.0 ** 62 and max(map(abs, model.sums), default=0) < 2 ** 62:
        return ((model.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((model.n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    dim, k = len(model.sums), len(model.values)
    explained = model.values / model.trace if model.trace else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, NUMBERS // (dim + 8 * k))):
            if batch.num_rows and k:
                x = whole(batch.column("v"), dim)
                rows_in, m = np.repeat(np.arange(len(x)), k), len(x)
                deviation = pa.array(deviations(x, model), pa.int64()).take(pa.array(rows_in))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows_in)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n)), deviation, pa.array(whitened(x, model).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return whiten(rows, fit(rows) or Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0))


QUERIES = {"op13_spectrum_whitening": op13_spectrum_whitening}
ORACLE_SQL: dict[str, str] = {}
