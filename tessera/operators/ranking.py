"""From candidates to hits: merge, blend, cut, rerank, diversify, hydrate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTOR_SHARE, LEXICAL_SHARE = 0.55, 0.45
POOL, KEEP, PER_DOC = 30, 18, 2


def merged(lexical: DataFrame, vector: DataFrame, by: list[str]) -> DataFrame:
    """The union of both candidate lists by key; a missing score is zero, several vector scores give their greatest."""
    rows = lexical.select(*by, F.col("score").alias("bm25"), F.lit(None).cast("double").alias("vec")).unionByName(vector.select(*by, F.lit(None).cast("double").alias("bm25"), F.col("score").alias("vec")))
    return rows.groupBy(*by).agg(F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25"), F.coalesce(F.max("vec"), F.lit(0.0)).alias("vec"))


def blended(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("blend", VECTOR_SHARE * F.col("vec") + LEXICAL_SHARE * F.col("bm25"))


def best(rows: DataFrame, order: list[Column], n: int, per: list[str] | None = None) -> DataFrame:
    """The first n rows, of all or of each group, with their rank."""
    if not per:
        top = rows.orderBy(*order).limit(n)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("rank") <= n)


def diversified(rows: DataFrame, order: list[Column], most: int = PER_DOC, per: list[str] | None = None) -> DataFrame:
    """At most `most` rows of each document, in order."""
    seen = F.row_number().over(Window.partitionBy(*(per or []), "doc_id").orderBy(*order))
    return rows.withColumn("_seen", seen).filter(F.col("_seen") <= most).drop("_seen")


def hydrated(hits: DataFrame, documents: DataFrame, columns: list[str]) -> DataFrame:
    """hits with columns of their documents; hits are few, so they are the side that Spark may broadcast."""
    return hits.join(documents.select("doc_id", *columns), "doc_id", "left")


def reranked(rows: DataFrame, n: int, per: list[str] | None = None) -> DataFrame:
    """The first n by a rerank score, by blend where that is equal (as after a failed model), then by window."""
    return best(rows, [F.desc("rerank"), F.desc("blend"), F.col("window_id")], n, per)


def hits_of(candidates: DataFrame, n: int = 8, pool: int = POOL, keep: int = KEEP, most: int = PER_DOC, per: list[str] | None = None) -> DataFrame:
    """The n hits of all, or of each question: pool by blend, rerank by blend, keep, diversify."""
    order = [F.desc("blend"), F.col("window_id")]
    kept = best(best(blended(candidates), order, pool, per).drop("rank"), order, keep, per).drop("rank")
    return best(diversified(kept, order, most, per), order, n, per)


def related(hits: DataFrame, cited: DataFrame, n: int = 3) -> DataFrame:
    """The first n hits of documents that weren't cited."""
    return best(hits.drop("rank").join(cited.select("doc_id").distinct(), "doc_id", "left_anti"), [F.desc("blend"), F.col("window_id")], n)


def first_window(windows: DataFrame) -> DataFrame:
    """The first window of each document: a minimum that combines before the shuffle, no sort."""
    rest = [c for c in windows.columns if c != "doc_id"]
    return windows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("page_start", "window_id")).alias("w")).select("doc_id", "w.*")


def in_categories(documents: DataFrame, wanted: list[str], column: str = "categories") -> DataFrame:
    """Documents of one of the categories, and all that have none."""
    own = F.col(column)
    return documents.filter(own.isNull() | (F.size(own) == 0) | F.arrays_overlap(own, F.array(*[F.lit(c) for c in wanted])))
