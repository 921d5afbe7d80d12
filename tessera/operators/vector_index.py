"""A stored vector index: inverted lists of cells, binary codes as a prefilter, and exact cosines of what is left.

Cells come from a bounded sample (SAMPLE rows, those of the least hashes), on which k-means runs in the driver; every row is then put
into the list of its nearest centre, with one sign bit for each component, and lists are stored as folders. A question looks into the
`probes` nearest cells. There, distances between codes are counted first: the least distance within which at least `pool` rows lie is
found for each question, all rows at that distance or less are kept, ties included, and their cosines are exact. How many cells
to probe and which share of the rows to keep is set when the index is made, as the least that reaches the wished recall on the sample. Questions are sent, vectors.BATCH at a time, to the rows of all cells: distances
and cosines are products of matrices, and what a task gives back is counts, and then the best of its rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.operators.vectors import BATCH, PAIRS, SLACK, best_of_all, binary_code, matrix, scores

#: Rows that cells and probes are fitted on, and the most cells.
SAMPLE, CELLS = 4096, 1024
ROUNDS, WISHED = 12, 0.97
#: Pairs of a question and a row that are looked at at once.
PRODUCTS = 1 << 20


@dataclass(frozen=True)
class Facts:
    """What an index is read with."""

    dim: int
    probes: int
    pool: int
    centres: list[list[float]]


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1.0)


def fitted_centres(units: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds from evenly spaced ones; empty cells keep their centre."""
    centres = units[:: max(1, len(units) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        own = (units @ centres.T).argmax(axis=1)
        for c in np.unique(own):
            centres[c] = units[own == c].mean(axis=0)
        centres = _units(centres)
    return centres


def calibrated(units: np.ndarray, centres: np.ndarray, k: int, wished: float) -> tuple[int, int]:
    """(probes, pool): the fewest cells, then the fewest rows by code, that hold `wished` of the k nearest of a part of the sample."""
    asked = np.arange(0, len(units), max(1, len(units) // 200))
    near = units[asked] @ units.T
    k = min(k, len(units))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = (units @ centres.T).argmax(axis=1)
    order = np.argsort(-(units[asked] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(np.sqrt(wished) * len(needed))))]) + 1
    signs = np.where(units > 0, 1.0, -1.0)
    apart = -(signs[asked] @ signs.T)
    ranks = np.empty_like(apart)
    np.put_along_axis(ranks, np.argsort(apart, axis=1, kind="stable"), np.arange(len(units), dtype=float)[None, :], axis=1)
    rows = np.sort(np.take_along_axis(ranks, top, axis=1).ravel())
    return probes, int(rows[min(len(rows) - 1, int(np.ceil(np.sqrt(wished) * len(rows))))]) + 1


def within_pool(pairs: DataFrame, pool: int) -> DataFrame:
    """(qid, cut): the least distance within which each question has `pool` of its pairs (qid, apart), or all of them."""
    return _cuts(pairs.groupBy("qid", "apart").agg(F.count("*").alias("n")), pool)


def _cuts(counts: DataFrame, pool: int) -> DataFrame:
    """within_pool() of counts by distance (qid, apart, n), as many as a code has bits for each question."""
    upto = F.sum("n").over(Window.partitionBy("qid").orderBy("apart"))
    reached = counts.withColumn("upto", upto)
    return reached.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("upto") >= pool, F.col("apart"))), F.max("apart")).alias("cut"))


def _signs(codes: pa.Array, words: int) -> np.ndarray:
    """The bits of codes of so many words as 1 and -1: products of them count in how many bits two codes differ."""
    bits = np.ascontiguousarray(codes.flatten().to_numpy().reshape(-1, words)).view(np.uint8)
    return np.unpackbits(bits, axis=1, bitorder="little").astype(np.float32) * 2 - 1


def _probed(asked: pa.Table) -> np.ndarray:
    """Which question looks into which cell."""
    cells = asked.column("cells").combine_chunks()
    of, cell = np.repeat(np.arange(asked.num_rows), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()
    out = np.zeros((asked.num_rows, int(cell.max(initial=-1)) + 1), bool)
    out[of, cell] = True
    return out


def _blocks(cell: np.ndarray, probed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(questions, rows): all pairs of a row and a question that looks into its cell, PRODUCTS at a time."""
    order = np.argsort(cell, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
        own = cell[rows[0]]
        questions = np.flatnonzero(probed[:, own]) if own < probed.shape[1] else []
        step = max(1, PRODUCTS // max(1, len(questions)))
        for first in range(0, len(rows) if len(questions) else 0, step):
            yield questions, rows[first : first + step]


def _apart(questions: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return ((questions.shape[1] - questions @ rows.T) / 2).astype(np.int32)


def _counted(sent: Broadcast, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (code, cell) to (qid, apart, n): how many of a task's rows lie how far from each question, which is known by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, probed, wide = _signs(sent.value.column("qcode").combine_chunks(), words), _probed(sent.value), words * 64 + 1
        total = np.zeros((len(signs), wide), np.int64)
        for batch in batches:
            own = _signs(batch.column("code"), words)
            for q, rows in _blocks(batch.column("cell").to_numpy(), probed):
                at = _apart(signs[q], own[rows]) + np.arange(len(q))[:, None] * wide
                total[q] += np.bincount(at.ravel(), minlength=len(q) * wide).reshape(len(q), wide)
        qid, apart = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(apart), pa.array(total[qid, apart])], ["qid", "apart", "n"])

    return run


def _best(sent: Broadcast, cut: np.ndarray, k: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, code, vector, cell) to (qid, id, score): a task's k nearest of each question within its distance by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, probed = -(-dim // 64), _probed(sent.value)
        qid, qvec, qcode = (sent.value.column(c).combine_chunks() for c in ("qid", "qvec", "qcode"))
        asked, signs = matrix(qvec, dim), _signs(qcode, words)
        length = np.sqrt(scores(asked, asked))
        units, worst, held = _units(asked), np.full(len(asked), -np.inf), None
        for batch in batches:
            own, v = _signs(batch.column("code"), words), matrix(batch.column("vector"), dim)
            norm, v_units = np.sqrt(scores(v, v)), _units(v)
            parts = [] if held is None else [held]
            for q, rows in _blocks(batch.column("cell").to_numpy(), probed):
                near = units[q] @ v_units[rows].T
                near[np.isnan(near)] = np.inf  # as in Spark's order
                near[(_apart(signs[q], own[rows]) > cut[q][:, None]) | (norm[rows] * length[q][:, None] == 0)] = -np.inf
                least = worst[q]
                if len(rows) > k:
                    least = np.maximum(least, np.partition(near, len(rows) - k, axis=1)[:, -k])
                i, j = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
                i, j = q[i], rows[j]
                score = np.concatenate([np.zeros(0), *[scores(v[j[p : p + PAIRS]], asked[i[p : p + PAIRS]]) for p in range(0, len(i), PAIRS)]]) / (norm[j] * length[i])
                parts.append((i, batch.column("id").take(pa.array(j)), score))
            if parts:
                held = best_of_all(parts, k, len(asked))
                # a question that has its k needs nothing below the last of them
                ends = np.searchsorted(held[0], np.arange(len(asked)), "right")
                full = np.flatnonzero(np.bincount(held[0], minlength=len(asked)) >= k)
                last = held[2][ends[full] - 1]
                worst[full] = np.where(np.isnan(last), np.inf, last)
        if held is not None:
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(held[0])), held[1], pa.array(held[2])], ["qid", "id", "score"])

    return run


def rescored(rows: DataFrame, asked: DataFrame, k: int, pool: int, dim: int) -> DataFrame:
    """(qid, rank, id, score): the k nearest of each of asked (qid, qvec, qcode, cells) among rows (id, code, vector, cell) of its cells, by code first.

    Rows go over a batch of questions twice, once to count distances of codes and once for cosines. Vectors that aren't of length dim have none.
    """
    spark = rows.sparkSession
    shipped(spark)
    sound = lambda c: F.col(c).isNotNull() & (F.size(c) == dim) & ~F.exists(F.col(c), lambda x: x.isNull())
    asked = asked.filter(F.col("qid").isNotNull() & sound("qvec")).select("qid", F.col("qvec").cast("array<double>").alias("qvec"), "qcode", "cells")
    # a task gives back k rows for each question, so a table of many small files is no more tasks than cores need
    own = rows.filter(sound("vector")).select("id", "code", F.col("vector").cast("array<double>").alias("vector"), "cell").coalesce(2 * spark.sparkContext.defaultParallelism)
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((asked, "qid"), (own, "id"))}
    passes, out = max(1, -(-asked.count() // BATCH)), None
    for i in range(passes):
        table = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast(table)
        counts = own.select("code", "cell").mapInArrow(_counted(sent, -(-dim // 64)), "qid long, apart long, n long")
        cut = np.full(table.num_rows, -1)
        for row in _cuts(counts.groupBy("qid", "apart").agg(F.sum("n").alias("n")), pool).collect():
            cut[row["qid"]] = row["cut"]
        best = own.mapInArrow(_best(sent, cut, k, dim), f"qid {kinds['qid']}, id {kinds['id']}, score double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        best = best.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def in_blocks(rows: DataFrame, asked: DataFrame, k: int, pool: int, dim: int) -> DataFrame:
    """rescored() without cells: every question looks at every row."""
    return rescored(rows.withColumn("cell", F.lit(0)), asked.withColumn("cells", F.array(F.lit(0))), k, pool, dim)


@dataclass(frozen=True)
class VectorIndex:
    """Lists of cells under a folder, and the facts to read them with."""

    spark: SparkSession
    path: str
    facts: Facts

    @staticmethod
    def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", k: int = 20, wished: float = WISHED, sample: int = SAMPLE, cells: int | None = None) -> VectorIndex:
        """Writes the index of all rows with an id and a vector. cells: by default the root of the row count, from 1 to CELLS."""
        spark = vectors.sparkSession
        rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        if not some:
            raise ValueError("there is nothing to index")
        units = _units(np.array([r["vector"] for r in some]))
        n = rows.count()
        # where the sample isn't all, probes and pool are judged on rows that the cells don't know, as most rows are
        fit, judged = (units, units) if len(units) == n or len(units) < 2 else (units[::2], units[1::2])
        cells = cells or min(CELLS, max(1, round(n**0.5)), max(1, len(fit) // 4))
        centres = fitted_centres(fit, cells)
        probes, pool = calibrated(judged, centres, k, wished)
        # a pool is a share of the rows: near codes are as many times more as there are more rows
        facts = Facts(units.shape[1], probes, -(-pool * n // len(judged)), [[float(x) for x in c] for c in centres])
        code = binary_code(F.col("vector"), facts.dim).alias("code")
        placed = _celled(rows, "vector", facts, 1).select("id", "vector", code, F.col("cells")[0].alias("cell"))
        # a cell's rows meet first, else every task writes a file to each cell; adaptive execution splits what is too large
        placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/lists")
        spark.createDataFrame([(json.dumps(asdict(facts)),)], "facts string").coalesce(1).write.parquet(f"{path}/facts")
        return VectorIndex(spark, path, facts)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        return VectorIndex(spark, path, Facts(**json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])))

    def lists(self) -> DataFrame:
        return self.spark.read.schema("id long, vector array<double>, code array<long>, cell int").parquet(f"{self.path}/lists")

    def top_k(self, asked: DataFrame, k: int = 20, probes: int | None = None, pool: int | None = None) -> DataFrame:
        """(qid, rank, id, score) for questions (qid, qvec): nearest rows by exact cosine among those found."""
        facts = replace(self.facts, probes=probes or self.facts.probes, pool=pool or self.facts.pool)
        own = asked.filter(F.col("qvec").isNotNull()).select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
        placed = _celled(own, "qvec", facts, facts.probes).select("qid", "qvec", binary_code(F.col("qvec"), facts.dim).alias("qcode"), "cells")
        return rescored(self.lists(), placed, k, facts.pool, facts.dim)


def _celled(rows: DataFrame, vector: str, facts: Facts, most: int) -> DataFrame:
    """rows with the numbers of the `most` nearest cells of each, the nearest first."""
    shipped(rows.sparkSession)
    centres = np.array(facts.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (batch.column(vector).value_lengths().to_numpy() != centres.shape[1]).any():
                raise ValueError(f"a vector isn't of length {centres.shape[1]}")
            near = -(matrix(batch.column(vector), centres.shape[1]) @ centres.T)
            order = near.argmin(axis=1)[:, None] if most == 1 else np.argsort(near, axis=1, kind="stable")[:, :most]
            ends = pa.array((np.arange(batch.num_rows + 1) * order.shape[1]).astype(np.int32))
            cells = pa.ListArray.from_arrays(ends, pa.array(order.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return rows.mapInArrow(run, rows.withColumn("cells", F.array(F.lit(0))).schema)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n (pairs of the exact answer), hit (those found) and recall."""
    hits = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.count("*").alias("n"), F.count("hit").alias("hit")).withColumn("recall", F.col("hit") / F.col("n"))
