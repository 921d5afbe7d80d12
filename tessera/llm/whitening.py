"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Vectors become whole numbers, and each distinct one is fitted once. Every task decomposes its vectors in blocks: a block keeps
its count, its exact sums, and all singular values and right vectors of its centred rows. Two such parts merge into one by
stacking both scaled bases under a row for the difference of their means, times the root of n1 * n2 / (n1 + n2), and
decomposing again: the squares of that stack are those of all rows about their common mean, so nothing is lost, and no
dimension is dropped on the way. Parts merge FAN at a time until one is left, whose size depends on the dimensions alone;
that one goes to the driver. Means are kept as whole sums, so a large offset common to all rows costs no precision.

Nulls: rows whose vector is null or holds a null or non-finite component are dropped; null ids stay, and repeated rows and
ids come out one by one. Vectors of different length are filled up with zeros. Components beyond 64 bits count as the
greatest or least 64-bit number, as does a deviation. A component without variance (fewer distinct vectors than dimensions,
constant dimensions) has a null `whitened`; identity_error is over the others, and null if there is none. Equal eigenvalues have
no order of their own: any basis of their space may come out, the same for all rows. An empty table gives an empty table.
Only id and vector are read, so other columns can't clash; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.llm.common import Scratch, written
from tessera.llm.topk import LEAST, MOST, _matrix

#: Rows that are decomposed together, and parts that one task merges.
BLOCK, FAN = 2048, 16
SCALE, OFFSET = 64, 1_000_000
#: Variance below this share of the largest one is rounding.
ROUNDING = 1e-13
PART = "grp long, n long, sums array<string>, basis binary"


@dataclass
class Part:
    """n rows: their sums as whole numbers of any size, and a matrix whose squares are those of the rows about their mean."""

    n: int
    sums: np.ndarray
    basis: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Part:
        """A block of whole-numbered rows, centred before anything is multiplied."""
        n, about = len(rows), rows[0]
        whole = rows.astype(object) - about.astype(object) if _wide(rows) else rows - about
        sums = whole.sum(axis=0, dtype=object)
        centred = (n * whole - sums).astype(np.float64) / n
        return Part(n, sums + n * about.astype(object), _decomposed(centred))

    def merged(self, other: Part) -> Part:
        n = self.n + other.n
        apart = (self.sums * other.n - other.sums * self.n).astype(np.float64) / (self.n * other.n)
        return Part(n, self.sums + other.sums, _decomposed(np.concatenate([self.basis, other.basis, math.sqrt(self.n * other.n / n) * apart[None, :]])))


def _wide(rows: np.ndarray) -> bool:
    """Whether differences or their sums may leave 64 bits."""
    return max(int(rows.max(initial=0)), -int(rows.min(initial=0))) * 2 * (len(rows) + 1) ** 2 >= 1 << 63


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors: as many rows as dimensions at most, all of them."""
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * vectors


@dataclass
class Fit:
    """The fitted whitening: count, whole sums, eigenvalues of the covariance from the largest down, and unit eigenvectors as rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(part: Part, most: int) -> Fit:
        _, singular, vectors = np.linalg.svd(part.basis, full_matrices=True)
        values = np.zeros(len(vectors))
        values[: len(singular)] = singular**2 / part.n
        values[values <= ROUNDING * values.max(initial=0.0)] = 0.0
        total = values.sum()
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
        return Fit(part.n, part.sums, values[:most], (vectors * signs[:, None])[:most], (values / total if total else values)[:most])

    def apart(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S of whole-numbered rows, exactly."""
        most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)), 1) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        if most < 1 << 62:
            return rows * self.n - self.sums.astype(np.int64)
        return rows.astype(object) * self.n - self.sums

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """Coordinates on the components over their standard deviations; those without variance are not a number."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (apart.astype(np.float64) / self.n) @ self.vectors.T / np.sqrt(self.values), np.nan)


def _deviation(apart: np.ndarray) -> list[int]:
    """Sums of squares, exactly, held at the greatest 64-bit number."""
    most = max(int(apart.max(initial=0)), -int(apart.min(initial=0)))
    if most * most * apart.shape[1] < 1 << 63:
        return (apart * apart).sum(axis=1).tolist()
    return [min(MOST, int(x)) for x in (apart.astype(object) ** 2).sum(axis=1)]


def _row(part: Part, grp: int) -> dict:
    return {"grp": grp, "n": part.n, "sums": [str(s) for s in part.sums], "basis": part.basis.tobytes()}


def _part(row: dict) -> Part:
    sums = np.array([int(s) for s in row["sums"]], object)
    return Part(row["n"], sums, np.frombuffer(row["basis"], np.float64).reshape(-1, len(sums)))


def _table(parts: list[dict]) -> pa.Table:
    kinds = [("grp", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("basis", pa.binary())]
    return pa.Table.from_pylist(parts, pa.schema(kinds))


def parts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One part for each task's rows (codes), numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                own = Part.of(_matrix(batch.slice(first, block).column("codes")))
                total = own if total is None else total.merged(own)
        if total is not None:
            yield from _table([_row(total, TaskContext.get().partitionId())]).to_batches()

    return rows.select("codes").mapInArrow(run, PART)


def fitted(rows: DataFrame, most: int, scratch: Scratch, block: int = BLOCK, fan: int = FAN) -> Fit | None:
    """The fit of distinct rows (codes); None for no rows. Parts merge `fan` at a time, round by round, each round written."""

    def run(group: pa.Table) -> pa.Table:
        total = None
        for row in group.sort_by("grp").to_pylist():
            total = _part(row) if total is None else total.merged(_part(row))
        return _table([_row(total, group.column("grp")[0].as_py() // fan)])

    now = scratch.written(parts(rows, block), "parts")
    left = now.count()
    while left > 1:
        now = scratch.written(now.groupBy(F.floor(F.col("grp") / fan)).applyInArrow(run, PART), "merged")
        left = now.count()
    last = now.first()
    return Fit.of(_part(last.asDict()), most) if last else None


def coded(vectors: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(key, codes) of all sound rows: floor(scale * c) + offset, filled up with zero components to the longest vector."""
    sound = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.filter(sound)
    lengths = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    # the sum is taken where both are held at 64 bits
    whole: Column = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**56, F.floor(scale * x) + F.lit(offset)).otherwise(F.when(x > 0, F.lit(MOST)).otherwise(F.lit(LEAST))))
    if lengths[0] != lengths[1]:
        whole = F.concat(whole, F.array_repeat(F.lit(offset).cast("long"), F.lit(lengths[1]) - F.size(vector)))
    return rows.select(F.col(key).alias("id"), whole.alias("codes"))


def whitened(vectors: DataFrame, components: int = 16, scale: int = SCALE, offset: int = OFFSET, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error for every sound row and each of the first components."""
    spark = vectors.sparkSession
    shipped(spark)
    rows = coded(vectors, key, vector, scale, offset)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double"
    with Scratch(spark, "whitening") as scratch:
        distinct = scratch.written(rows.select("codes").distinct(), "distinct")
        fit = fitted(distinct, components, scratch, block, fan)
        if fit is None:
            return spark.createDataFrame([], f"{schema}, identity_error double").withColumnRenamed("id", key)
        error = _identity_error(distinct, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(fit.values)
        for batch in batches:
            if not batch.num_rows or not many:
                continue
            apart = fit.apart(_matrix(batch.column("codes")))
            value = fit.whitened(apart).ravel()
            repeated = np.repeat(np.arange(batch.num_rows), many)
            columns = [batch.column("id").take(pa.array(repeated)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(value), fit.n)), pa.array(_deviation(apart), pa.int64()).take(pa.array(repeated))]
            columns += [pa.array(value, mask=np.isnan(value)), pa.array(np.tile(fit.explained, batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, schema).withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("id", key)


def _identity_error(distinct: DataFrame, fit: Fit) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity; summed by entry, a few numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(fit.values > 0)
        total, sums = np.zeros((len(seen), len(seen))), np.zeros(len(seen))
        for batch in batches:
            if batch.num_rows:
                value = fit.whitened(fit.apart(_matrix(batch.column("codes"))))[:, seen]
                total, sums = total + value.T @ value, sums + value.sum(axis=0)
        i, j = np.indices((len(seen), len(seen) + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, np.concatenate([total, sums[:, None]], axis=1).ravel())], ["i", "j", "x"])

    table = distinct.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # components squared
    if not table:
        return None
    size = 1 + max(r["i"] for r in table)
    held = np.zeros((size, size + 1))
    for r in table:
        held[r["i"], r["j"]] = r["x"] / fit.n
    mean = held[:, size]
    return float(np.abs(held[:, :size] - np.outer(mean, mean) - np.eye(size)).max())
