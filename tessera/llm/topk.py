"""Exact top-k inner products by block-at-a-time pruning.

Vectors become whole numbers. Rows are brought near others of their direction (they are sorted by the pivot that they point
along most, one of a bounded sample), and runs of them form the blocks of an index that is written once: a block holds its
vectors (the forward index) and the greatest and least value of each component. A query's bound for a block is the sum over
components of the most that the block's extremes allow. Blocks are taken in the order of their bounds, a block's vectors are
scored against all queries that are at it, and a query ends when the next bound is below its k-th score; the k-th score
among the pivots' vectors is where it begins. Pruning depends on the data: bounds are tight where vectors crowd, and of no
use for directions without any order.

Queries are taken in groups of bounded size, each of which is sent to all tasks that read the index; a task returns k rows
for each of its queries at most, and the last step ranks those. So the table is shuffled once, when the index is made. Scores
are exact: matrix products run in floating point only where every sum stays below 2**53, in 64-bit integers where it stays
below 2**63, and in whole numbers of any size beyond.

Nulls: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Components
beyond 64 bits count as the greatest or least 64-bit number, and so do scores. Vectors of different length are compared as
if the shorter ended in zeros. Several rows with one id: each is a candidate, and as a query the id is answered once, by its
least vector; rows with the query's own id are no candidates. Ties go to the smaller id. An empty table gives an empty
table. Only id and vector are read, so other columns can't clash; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.llm.common import Scratch, written

#: Rows of a block, queries of a group, rows of the sample that directions are told by, and blocks that are searched together.
BLOCK, GROUP, PIVOTS, TOGETHER = 256, 4096, 256, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PACK = "dim int, n int, kind string, ids binary, codes binary, high binary, low binary"
FOUND = "query_id long, vec_id long, score long"


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, filled up with zeros."""
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    dim = int(lengths.max(initial=0))
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the narrowest whole numbers that hold it."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    return matrix.astype(np.promote_types(np.min_scalar_type(low if low < 0 else -1), np.min_scalar_type(-high - 1)))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` neighbouring rows of (id long, codes array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                piece = batch.slice(first, size)
                matrix = _matrix(piece.column("codes"))
                ids = piece.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                codes = _narrow(matrix)
                extremes = {"high": matrix.max(axis=0, initial=LEAST), "low": matrix.min(axis=0, initial=MOST)}
                yield pa.RecordBatch.from_pydict({"dim": pa.array([matrix.shape[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "kind": [codes.dtype.str], "ids": [ids.tobytes()], "codes": [codes.tobytes()], **{n: [x.astype("<i8").tobytes()] for n, x in extremes.items()}})

    return rows.select("id", "codes").mapInArrow(run, PACK)


def _wide(matrix: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dim - matrix.shape[1]))) if matrix.shape[1] < dim else matrix


def _read(row: dict, dim: int) -> tuple[np.ndarray, ...]:
    """ids, codes, high and low of a packed block."""
    shape = lambda data, kind, n: _wide(np.frombuffer(data, kind).reshape(n, row["dim"]).astype(np.int64), dim)
    return np.frombuffer(row["ids"], "<i8"), shape(row["codes"], row["kind"], row["n"]), shape(row["high"], "<i8", 1)[0], shape(row["low"], "<i8", 1)[0]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact up to the bounds of 64 bits."""
    size = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = size(a) * size(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> tuple[list, int]:
    """(query id, vector id, score) of the best k of each query among blocks (ids, codes, high, low), and how many block visits were pruned.

    floor: for each query a score that k rows are known to reach; lower ones needn't be found.
    """
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    high, low = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    bounds = _product(np.concatenate([up, down], axis=1), np.concatenate([high, low], axis=1))
    order = np.argsort(bounds, axis=1, kind="stable")[:, ::-1]
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id) in order
    kth = np.full(len(queries), LEAST) if floor is None else floor.copy()
    active, visits = np.arange(len(queries)), 0
    for place in range(len(blocks)):
        at = order[active, place]
        stay = bounds[active, at] >= kth[active]  # a bound equal to the k-th score may hide a tie with a smaller id
        active, at = active[stay], at[stay]
        if not len(active):
            break
        visits += len(active)
        for block in np.unique(at):
            own = active[at == block]
            ids, codes = blocks[block][:2]
            scores = _product(queries[own], codes)
            counts = ids[None, :] != query_ids[own][:, None]
            least = kth[own]
            if scores.shape[1] > k + 1:  # one place may be the query's own
                least = np.maximum(least, np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)])
            row, column = np.nonzero((scores >= least[:, None]) & counts)
            for r in np.unique(row):
                q, mine = own[r], column[row == r]
                merged = sorted(best[q] + [(-x, i) for x, i in zip(scores[r, mine].tolist(), ids[mine].tolist())])[:k]
                best[q] = merged
                if len(merged) == k:
                    kth[q] = max(kth[q], -merged[-1][0])
    out = [(int(q), i, -s) for q, found in zip(query_ids, best) for s, i in found]
    return out, len(queries) * len(blocks) - visits


def _floors(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among a few rows that aren't its own; the least number where those are fewer."""
    scores = np.where(ids[None, :] == query_ids[:, None], LEAST, _product(queries, codes))
    return np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(queries), LEAST)


def _directed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (id, codes) with the number of the pivot that each points along most."""
    long = np.sqrt((pivots.astype(np.float64) ** 2).sum(axis=1))
    units = pivots / np.where(long > 0, long, 1.0)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("codes")).astype(np.float64)
            dim = min(matrix.shape[1], units.shape[1])
            best = (matrix[:, :dim] @ units[:, :dim].T).argmax(axis=1) if len(units) and len(matrix) else np.zeros(len(matrix), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("codes"), pa.array(best, pa.int64())], ["id", "codes", "pivot"])

    return rows.mapInArrow(run, "id long, codes array<long>, pivot long")


def index(rows: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The blocks of rows (id, codes), and ids and codes of the sample that directions are told by (the rows of the least hashes)."""
    sample = rows.orderBy(F.xxhash64("id", "codes"), "id").limit(pivots).collect()
    ids = np.array([r["id"] for r in sample], np.int64)
    codes = _matrix(pa.array([r["codes"] for r in sample], pa.list_(pa.int64()))) if sample else np.zeros((0, 0), np.int64)
    # ranges of pivot and id: a direction that many rows share is dealt over several tasks
    dealt = _directed(rows, codes).repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id")
    return _packed(dealt, block), ids, codes


def grouped(scratch: Scratch, rows: DataFrame, size: int, packed) -> DataFrame:
    """Rows packed into groups of about `size`, however many partitions they came in."""
    rows = scratch.written(rows, "asked")
    return scratch.written(packed(rows.repartition(max(1, -(-rows.count() // size))), size), "groups")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose id is divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    shipped(spark)
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(scale * x))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.filter(sound).select(F.col(key).cast("long").alias("id"), whole.alias("codes"))
    with Scratch(spark, "topk") as scratch:
        blocks, sample_ids, sample = index(rows, block, pivots)
        blocks = scratch.written(blocks, "index")
        asked = grouped(scratch, rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("codes").alias("codes")), group, _packed)
        found = None
        for row in asked.toLocalIterator():  # one group of queries at a time
            sent = spark.sparkContext.broadcast(row.asDict())
            part = scratch.written(blocks.mapInArrow(_answers(sent, sample_ids, sample, k), FOUND), "found")
            sent.destroy()
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], FOUND)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")


def _answers(group, sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """What a task finds for a group of queries among the blocks that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine in (batch.slice(first, TOGETHER).to_pylist() for batch in batches for first in range(0, batch.num_rows, TOGETHER)):
            dim = max([group.value["dim"], sample.shape[1], *(x["dim"] for x in mine)])
            ids, queries = _read(group.value, dim)[:2]
            found = search(queries, ids, [_read(x, dim) for x in mine], k, _floors(queries, ids, sample_ids, _wide(sample, dim), k))[0]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], ["query_id", "vec_id", "score"])

    return run
