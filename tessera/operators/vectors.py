"""Vectors as arrays: exact cosine, top-k for one or many queries, binary codes, means, and filling in embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import shipped

#: The most queries that one pass over the vectors carries; more are answered in several passes of that size.
BATCH = 2_000
#: Rows that meet a batch of queries at once, candidates that are scored at once, and how far products of unit vectors may round apart.
BLOCK, PAIRS, SLACK = 2_048, 65_536, 1e-9


@dataclass(frozen=True)
class Profile:
    """A model's name, the length of its vectors, and the column that holds them."""

    model: str
    size: int
    column: str = "embedding"


def of_profile(rows: DataFrame, profiles: dict[str, Profile], name: str | None, default: Profile, key: str = "vec_id") -> DataFrame:
    """(key, embedding) of the rows that have a vector of the named profile, or of the default where the name isn't known.

    Vectors of another length than the profile's are left out: they are another model's.
    """
    profile = profiles.get(name or "", default)
    own = rows.select(key, F.col(profile.column).alias("embedding"))
    return own.filter(F.col("embedding").isNotNull() & (F.size("embedding") == profile.size))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def top_k(vectors: DataFrame, query: list[float], k: int = 120, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine. Only id and vector are read; join what else is needed to the result."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    score = F.try_divide(dot(F.col(vector), literal), norm(F.col(vector)) * F.lit(length))
    return vectors.filter(F.col(vector).isNotNull()).select(key, score.alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors without nulls, of one length, as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows in pairs, summed from the first component on as dot() does, so equal vectors have equal scores."""
    out = np.zeros(len(a))
    for j in range(a.shape[1] if a.ndim == 2 else 0):
        out += a[:, j] * b[:, j]
    return out


def _best_of(rows: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of all that may be among the k nearest of a block: those at the k-th score or above it, as far as rounding goes."""
    near = asked @ rows.T
    near[np.isnan(near)] = np.inf  # as in Spark's order
    if near.shape[1] <= k:
        return np.nonzero(near == near)
    least = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
    return np.nonzero(near >= least[:, None] - SLACK)


def best_of_all(parts: list[tuple[np.ndarray, pa.Array, np.ndarray]], k: int, questions: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The k best of each question from parts (question, key, score), by question and from the best on; equal scores go by key."""
    question, score = (np.concatenate([p[c] for p in parts]) for c in (0, 2))
    keys = pa.chunked_array([p[1] for p in parts]).combine_chunks()
    place = pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy() if len(keys) else np.zeros(0, int)
    order = np.lexsort((place, np.where(np.isnan(score), -np.inf, -score), question))
    begins = np.searchsorted(question[order], np.arange(questions))
    best = order[np.arange(len(order)) - begins[question[order]] < k]
    return question[best], keys.take(pa.array(best)), score[best]


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 120, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest for each query (qid, qvec): qid, rank, key and score. Queries are sent BATCH at a time.

    Blocks of rows meet a batch of queries as a product of matrices, which tells candidates; their scores are summed as dot() does. A task keeps
    the best of its rows, so what is shuffled is k rows of each query from each task.
    """
    spark = vectors.sparkSession
    shipped(spark)
    sound = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(F.col(c), lambda x: x.isNull())
    asked = queries.filter(sound("qvec")).select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
    rows = vectors.filter(sound(vector)).select(key, F.col(vector).cast("array<double>").alias("v"))
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((asked, "qid"), (rows, key))}
    counts = asked.groupBy(F.size("qvec").alias("dim")).agg(F.count("*").alias("n")).collect()  # vectors of other lengths have no cosine
    # without questions there is nothing to send, and the result has no rows
    batches = [(r["dim"], -(-r["n"] // BATCH), i) for r in counts for i in range(-(-r["n"] // BATCH))] or [(0, 1, 0)]
    out = None
    for dim, passes, i in batches:
        part = asked.filter((F.size("qvec") == dim) & (F.pmod(F.xxhash64("qid"), F.lit(passes)) == i))
        sent = spark.sparkContext.broadcast(part.toArrow().combine_chunks())
        best = rows.filter(F.size("v") == dim).mapInArrow(_nearest(sent, k), f"qid {kinds['qid']}, {key} {kinds[key]}, score double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
        best = best.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", key, "score")
        out = best if out is None else out.unionByName(best)
    return out


def _nearest(sent: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of batch_top_k: rows (key, v) to (qid, key, score), at least the k best of the task for each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        if not table.num_rows:
            return
        qid, qvec = (table.column(c).combine_chunks() for c in ("qid", "qvec"))
        dim = len(qvec[0])
        q = matrix(qvec, dim)
        length = np.sqrt(scores(q, q))
        q_units = q / np.where(length > 0, length, 1.0)[:, None]
        held, name = None, ""  # question, key, score of the best so far
        for batch in batches:
            if not batch.num_rows:
                continue
            name, v = batch.schema.names[0], matrix(batch.column("v"), dim)
            norm_ = np.sqrt(scores(v, v))
            units = v / np.where(norm_ > 0, norm_, 1.0)[:, None]
            parts = [] if held is None else [held]
            for first in range(0, len(v), BLOCK):
                question, row = _best_of(units[first : first + BLOCK], q_units, k)
                row = row + first
                live = norm_[row] * length[question] != 0
                question, row = question[live], row[live]
                score = np.concatenate([np.zeros(0), *[scores(v[row[p : p + PAIRS]], q[question[p : p + PAIRS]]) for p in range(0, len(row), PAIRS)]]) / (norm_[row] * length[question])
                parts.append((question, batch.column(0).take(pa.array(row)), score))
            held = best_of_all(parts, k, len(q))
        if held is not None:
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(held[0])), held[1], pa.array(held[2])], ["qid", name, "score"])

    return run


def binary_code(a: Column, size: int) -> Column:
    """One bit for each component above zero, in 64-bit words."""
    words = []
    for first in range(0, size, 64):
        bits = F.transform(F.slice(a, first + 1, min(64, size - first)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def mean_vectors(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """The mean of each group's vectors, component by component: sums combine before the shuffle."""
    parts = rows.filter(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("at", "x"))
    means = parts.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))


def hashed_words(text: str, size: int) -> list[float]:
    """A stand-in for a model: counts of words at hashed places, signed by the hash, at unit length."""
    out = [0.0] * size
    for word in (text or "").lower().split():
        h = xxhash.xxh64_intdigest(word)
        out[h % size] += 1.0 if h >> 63 else -1.0
    length = sum(x * x for x in out) ** 0.5
    return [x / length for x in out] if length else out


def embedded(rows: DataFrame, size: int, model: Callable[[list[str]], list[list[float]]] | None = None, text: str = "text", vector: str = "embedding", batch: int = 64, again: bool = False) -> DataFrame:
    """rows with missing vectors filled in by the model, `batch` texts at a time; a vector of another length is an error."""
    embed = model or (lambda texts: [hashed_words(t, size) for t in texts])
    shipped(rows.sparkSession)
    missing = rows if again else rows.filter(F.col(vector).isNull())
    schema = rows.drop(vector).withColumn(vector, F.array(F.lit(0.0).cast("float"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in batches:
            for first in range(0, rows_.num_rows, batch):
                part = rows_.slice(first, batch)
                made = embed([t or "" for t in part.column(text).to_pylist()])
                if any(len(v) != size for v in made):
                    raise ValueError(f"the model returned a vector that isn't of length {size}")
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in part.schema.names], pa.array(made, pa.list_(pa.float32()))], [*part.schema.names, vector])

    filled = missing.drop(vector).mapInArrow(run, schema)
    return filled if again else rows.filter(F.col(vector).isNotNull()).select(*filled.columns).unionByName(filled)


def rescored(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], question: str, text: str) -> DataFrame:
    """pairs with the score of a reranking model, in Arrow batches; 0.5 for all of a batch that the model fails on."""

    shipped(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(questions.tolist(), texts.str.slice(0, 1500).tolist()))
        except Exception:  # noqa: BLE001  the model is foreign code, and the order by blend is left without it
            return pd.Series([0.5] * len(texts))

    return pairs.withColumn("rerank", score(F.col(question), F.col(text)))
