"""Hard negatives by blocked matrix products: for each anchor its best rows of the same label, then near rows of other labels.

Vectors become whole numbers and are packed once into blocks of candidates, a table that both passes read. Anchors go over it
in groups of bounded size, each sent to all tasks. The first pass multiplies the group with every block in floating point
(exact while sums stay below 2**53, wider whole numbers beyond) and keeps the best rows of the anchor's own label; what tasks
keep merges by taking the best again. The second pass multiplies again and keeps, for each anchor and positive, the best rows
of other labels whose score lies in the window that the positive's score opens. A task holds the best of its own blocks
only, so nothing grows with the table but the number of blocks that go by.

Nulls: rows without an id, a label or a vector, or with a null or non-finite component, take no part. Several rows with one
id: each is a candidate of its own, as an anchor the id is asked once, by its least vector and then label, and rows with the
anchor's own id are no candidates for it. Vectors of different length are compared as if the shorter ended in zeros.
Components and scores beyond 64 bits are held at the bounds. Ties go to the smaller id; rows with equal scores and ids count
one by one. A positive below zero opens no window, one of zero only that of zero. An empty table gives an empty table. Only
id, label and vector are read, so other columns can't clash; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.llm.common import Scratch, written
from tessera.llm.topk import LEAST, _matrix, _narrow, _product, _wide, grouped

#: Rows of a candidate block, anchors that are multiplied with one at a time, and anchors that are sent to all tasks together.
BLOCK, AT_ONCE, GROUP = 4096, 512, 16384
PACK = "dim int, n int, kind string, ids binary, labels binary, codes binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows of (id long, label long, codes array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                piece = batch.slice(first, size)
                codes = _narrow(_matrix(piece.column("codes")))
                plain = lambda c: piece.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes()  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"dim": pa.array([codes.shape[1]], pa.int32()), "n": pa.array([len(codes)], pa.int32()), "kind": [codes.dtype.str], "ids": [plain("id")], "labels": [plain("label")], "codes": [codes.tobytes()]})

    return rows.select("id", "label", "codes").mapInArrow(run, PACK)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and codes of a packed block."""
    codes = np.frombuffer(row["codes"], row["kind"]).reshape(row["n"], row["dim"]).astype(np.int64)
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), codes


def _nth(row: np.ndarray) -> np.ndarray:
    """The place of each within its run of equal values, for ascending values."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def first_places(scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best fitting scores of every row, ties to the smaller id, best first within a row."""
    held = np.where(fit, scores, LEAST)
    least = np.partition(held, -k, axis=1)[:, -k] if held.shape[1] > k else np.full(len(held), LEAST)
    row, column = np.nonzero(fit & (held >= least[:, None]))
    order = np.lexsort((ids[column], ~held[row, column], row))  # ~x falls as x rises, without leaving 64 bits
    row, column = row[order], column[order]
    keep = _nth(row) < k
    return row[keep], column[keep]


class Best:
    """The k best (score, id) of each of n keys so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.id, self.full = np.full((n, k), LEAST), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in rows of ascending keys, k of a key at most."""
        if not len(keys):
            return
        own, at = np.unique(keys, return_inverse=True)
        nth = _nth(keys)
        new = [np.full((len(own), self.k), LEAST), np.zeros((len(own), self.k), np.int64), np.zeros((len(own), self.k), bool)]
        for table, values in zip(new, (scores, ids, True)):
            table[at, nth] = values
        both = [np.concatenate([a[own], b], axis=1) for a, b in zip((self.score, self.id, self.full), new)]
        row, column = _merged(*both, self.k)
        for table, values, empty in zip((self.score, self.id, self.full), both, (LEAST, 0, False)):
            table[own] = empty
            table[own[row], _nth(row)] = values[row, column]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, id, score) of all that is held."""
        key, place = np.nonzero(self.full)
        return key, self.id[key, place], self.score[key, place]


def _merged(score: np.ndarray, ids: np.ndarray, full: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row of small tables."""
    row, column = np.nonzero(full)
    order = np.lexsort((ids[row, column], ~score[row, column], row))
    row, column = row[order], column[order]
    keep = _nth(row) < k
    return row[keep], column[keep]


def positives(anchors: tuple, blocks: Iterator[tuple], k: int) -> Best:
    """The k best rows of the anchors' own labels among blocks (ids, labels, codes)."""
    own_ids, own_labels, own = anchors
    best = Best(len(own), k)
    for ids, labels, codes in blocks:
        for at in range(0, len(own), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            fit = (labels[None, :] == own_labels[part, None]) & (ids[None, :] != own_ids[part, None])
            scores = _scores(own[part], codes)
            row, column = first_places(scores, fit, ids, k)
            best.add(row + at, scores[row, column], ids[column])
    return best


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dim = max(a.shape[1], b.shape[1])
    return _product(_wide(a, dim), _wide(b, dim))


def negatives(anchors: tuple, asked: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: Iterator[tuple], k: int) -> Best:
    """The k best rows of other labels for each of asked (ascending place of the anchor, least and greatest score allowed)."""
    own_ids, own_labels, own = anchors
    of, low, high = asked
    best = Best(len(of), k)
    for ids, labels, codes in blocks:
        for at in range(0, len(own), AT_ONCE):
            begin, end = np.searchsorted(of, [at, at + AT_ONCE])
            scores = _scores(own[at : at + AT_ONCE], codes)
            other = labels[None, :] != own_labels[at : at + AT_ONCE, None]
            for first in range(begin, end, AT_ONCE):
                ask = slice(first, min(first + AT_ONCE, end))
                mine = scores[of[ask] - at]
                fit = other[of[ask] - at] & (mine >= low[ask, None]) & (mine <= high[ask, None])
                row, column = first_places(mine, fit, ids, k)
                best.add(row + first, mine[row, column], ids[column])
    return best


def mined(vectors: DataFrame, n_positives: int = 5, n_negatives: int = 3, every: int = 50, window: tuple[int, int] = (50, 95), scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: the best negatives within the window.

    Anchors are the rows whose id is divisible by `every`; the window gives the least and greatest negative score in hundredths
    of the positive's.
    """
    spark = vectors.sparkSession
    shipped(spark)
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(scale * x))
    label = F.col(label) if isinstance(label, str) else label
    sound = F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.filter(sound).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("codes"))
    with Scratch(spark, "negatives") as scratch:
        blocks = scratch.written(_packed(rows, block), "candidates")
        ask = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("codes", "label")).alias("own"))
        asked = grouped(scratch, ask.select("id", F.col("own.label").alias("label"), F.col("own.codes").alias("codes")), group, _packed)
        found = None
        for row in asked.toLocalIterator():  # one group of anchors at a time
            part = _of_group(scratch, blocks, row.asDict(), n_positives, n_negatives, window)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def _of_group(scratch: Scratch, blocks: DataFrame, packed: dict, n_positives: int, n_negatives: int, window: tuple[int, int]) -> DataFrame:
    """Both passes for one group of anchors."""
    spark = blocks.sparkSession
    group = spark.sparkContext.broadcast(packed)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _read(group.value)
        key, ids, scores = positives(anchors, (_read(r) for b in batches for r in b.to_pylist()), n_positives).rows()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[0][key], key, ids, scores)], ["anchor_id", "at", "positive_id", "positive_score"])

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    merged = blocks.mapInArrow(near, "anchor_id long, at long, positive_id long, positive_score long").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= n_positives)
    kept = scratch.written(merged, "positives")
    # one group's positives: n_positives for each of at most GROUP anchors
    got = kept.orderBy("at", "nth").toPandas()
    low = [-(-window[0] * s // 100) for s in got["positive_score"].tolist()]
    high = [window[1] * s // 100 for s in got["positive_score"].tolist()]
    windows = spark.sparkContext.broadcast((got["at"].to_numpy(np.int64), np.array(low, np.int64), np.array(high, np.int64)))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, scores = negatives(_read(group.value), windows.value, (_read(r) for b in batches for r in b.to_pylist()), n_negatives).rows()
        at, nth = windows.value[0][key], (_nth(windows.value[0])[key] + 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, nth, ids, scores)], ["at", "nth", "negative_id", "negative_score"])

    best = Window.partitionBy("at", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = blocks.mapInArrow(hard, "at long, nth int, negative_id long, negative_score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_negatives)
    out = written(ranked.join(kept, ["at", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for sent in (group, windows):
        sent.destroy()
    return out
