"""From a question to hits: plan, candidates of both kinds, merge, rerank, keep, diversify, hydrate, and what the hits cite.

Words are looked up in the stored index, so a question reads the postings of its terms and no text. Texts are fetched for the pool that
a model reranks (30 windows at most) and for the windows that are returned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import kept
from tessera.functions.questions import Plan, plan
from tessera.operators import graph, ranking, segments, vectors
from tessera.operators.inverted import Index

CANDIDATES = 120
AT = ["window_id", "doc_id", "page_start", "page_end"]


def allowed_documents(documents: DataFrame, include_archived: bool = False, categories: list[str] | None = None) -> DataFrame | None:
    """(doc_id) of current documents, or of all, in the categories if some are named (documents without any count as in all); None: no limit."""
    if include_archived and not categories:
        return None
    out = documents if include_archived else documents.filter("is_current")
    return (ranking.in_categories(out, categories) if categories else out).select("doc_id")


def candidates(index: Index, embeddings: DataFrame, text: str, queries: list[list[float]], allowed: DataFrame | None = None, n: int = CANDIDATES) -> DataFrame:
    """Windows with bm25, vec and blend: the n best for the text, and for each query vector the first windows of the n best documents."""
    spark = embeddings.sparkSession
    words = index.search(text, n, allowed).select(*AT, "score")
    own = index.windows() if allowed is None else index.windows().join(allowed, "doc_id", "left_semi")
    first = ranking.first_window(own.select("doc_id", "window_id", "page_start", "page_end"))
    rows = embeddings.join(first.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "qid int, qvec array<double>")
    near = vectors.batch_top_k(rows, asked, 4 * n).select("qid", F.col("vec_id").alias("doc_id"), "score")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "window_id"))
    placed = first.join(near, "doc_id").withColumn("nth", nth).filter(F.col("nth") <= n)
    return ranking.blended(ranking.merged(words, placed, AT))


def hybrid(index: Index, embeddings: DataFrame, documents: DataFrame, text: str, query: list[float], n: int = 8, include_archived: bool = False, categories: list[str] | None = None) -> DataFrame:
    """The n hits of one question by blend alone: rank, window_id, doc_id, pages, both scores, the blend, and the documents' columns."""
    allowed = allowed_documents(documents, include_archived, categories)
    return ranking.hydrated(ranking.hits_of(candidates(index, embeddings, text, [query], allowed), n), documents, ["lang", "source"])


def with_texts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """A few windows with their text, which is cut from their documents alone."""
    own = documents.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    return rows.join(segments.windows(own).select("window_id", "text"), "window_id")


@dataclass(frozen=True)
class Found:
    """What a question found: its plan, ranked hits, and the first windows of documents that those cite or that cite them."""

    plan: Plan
    hits: DataFrame
    cited: DataFrame


@dataclass(frozen=True)
class Corpus:
    """What is searched: the index, vectors by document, documents (doc_id, text, is_current, categories, ...), and citations (src, dst)."""

    index: Index
    embeddings: DataFrame
    documents: DataFrame
    edges: DataFrame


def answer(
    corpus: Corpus,
    question: str,
    embed: Callable[[list[str]], list[list[float]]],
    planner: Callable[[str], dict] | None = None,
    scorer: Callable[[list[str], list[str]], list[float]] | None = None,
    include_archived: bool = False,
    categories: list[str] | None = None,
    n: int = 8,
    rewrites: int = 3,
    depth: int = 2,
    cited: int = 4,
) -> Found:
    """The whole chain. Without a planner the question is its own plan; without a scorer the blend is the rank; a scorer that fails leaves
    the order by blend.

    The words of the plan are searched once, the vectors of all rewrites together in one pass. Categories limit only if the caller
    names them; those of the plan are for display.
    """
    made = plan(question, planner, rewrites)
    allowed = allowed_documents(corpus.documents, include_archived, categories)
    pool = ranking.best(candidates(corpus.index, corpus.embeddings, made.lexical, embed(made.rewrites), allowed), [F.desc("blend"), F.col("window_id")], ranking.POOL).drop("rank")
    if scorer is None:
        scored = pool.withColumn("rerank", F.col("blend"))
    else:
        texts = with_texts(kept(pool, "pool"), corpus.documents).withColumn("question", F.lit(question))
        scored = vectors.rescored(texts.coalesce(1), scorer, "question", "text").drop("question", "text")  # a pool is one call of the model
    order = [F.desc("rerank"), F.desc("blend"), F.col("window_id")]
    best = ranking.reranked(kept(scored, "reranked"), ranking.KEEP).drop("rank")
    hits = kept(ranking.best(ranking.diversified(best, order), order, n), "hits")
    near = graph.expansion(corpus.edges, hits.select("doc_id"), depth, cited)
    return Found(made, ranking.hydrated(hits, corpus.documents, ["lang", "source"]), first_windows_of(corpus, near, include_archived))


def first_windows_of(corpus: Corpus, near: DataFrame, include_archived: bool = False) -> DataFrame:
    """(doc_id, distance, window_id, page_start, page_end, text) of near (doc_id, distance): their first windows, nearest first."""
    rows = near if include_archived else near.join(corpus.documents.filter("is_current").select("doc_id"), "doc_id", "left_semi")
    first = ranking.first_window(corpus.index.windows().join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id", "window_id", "page_start", "page_end"))
    return with_texts(rows.join(first, "doc_id"), corpus.documents)
