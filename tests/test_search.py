"""The whole search chain on a small corpus."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import segments
from tessera.operators.inverted import Index
from tessera.plans import search

TEXTS = {
    1: "alpha beta\ngamma alpha\nalpha tail",
    2: "alpha alpha alpha\nnothing here",
    3: "beta only\nmore beta",
    4: "archived alpha alpha alpha alpha\nalpha",
    5: "delta\nepsilon",
    6: "cited page one\ncited page two",
}
VECTORS = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0], 4: [1.0, 0.0], 5: [0.1, 1.0], 6: [-1.0, 0.0]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, t, "en" if i != 3 else None, "s", i != 4, [] if i == 5 else ["x"] if i % 2 else ["y"]) for i, t in TEXTS.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, is_current boolean, categories array<string>")
    index = Index.build(segments.windows(docs), f"file://{tmp_path_factory.mktemp('s')}/i", shards=4)
    vectors = spark.createDataFrame(list(VECTORS.items()), "vec_id long, embedding array<float>")
    edges = spark.createDataFrame([(1, 6), (6, 4), (5, 2), (6, 3)], "src long, dst long")
    return search.Corpus(index, vectors, docs, edges)


def embed(texts):
    return [[1.0, 0.0] if "first" in t or "alpha" in t else [0.0, 1.0] for t in texts]


def planner(question):
    return {"rewrites": ["first way", "second way", "third", "fourth"], "bm25_query": "alpha", "categories": ["x"]}


def order(found):
    return [r.window_id for r in found.hits.orderBy("rank").collect()]


def test_blend_is_the_rank_without_a_scorer(corpus):
    found = search.answer(corpus, "where is alpha written about?", embed, planner)
    hits = found.hits.orderBy("rank").collect()
    assert found.plan.rewrites == ["where is alpha written about?", "first way", "second way"] and found.plan.lexical == "alpha"
    assert all(r.rerank == r.blend for r in hits) and [r.blend for r in hits] == sorted((r.blend for r in hits), reverse=True)
    assert max(sum(r.doc_id == d for r in hits) for d in TEXTS) <= 2 and 4 not in {r.doc_id for r in hits}
    # the best of both vectors counts: document 3 is near the second way
    assert {r.doc_id: round(r.vec, 6) for r in hits if r.page_start == 1}[3] == 1.0


def test_a_scorer_decides_and_its_failure_leaves_the_blend(corpus):
    plain = order(search.answer(corpus, "where is alpha?", embed, planner))
    longest = search.answer(corpus, "where is alpha?", embed, planner, lambda q, texts: [float(len(t)) for t in texts])
    scores = [r.rerank for r in longest.hits.orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True) and order(longest) != plain

    def broken(questions, texts):
        raise OSError("no model")

    failed = search.answer(corpus, "where is alpha?", embed, planner, broken)
    assert order(failed) == plain and {r.rerank for r in failed.hits.collect()} == {0.5}


def test_simple_questions_and_failing_planners_are_their_own_plan(corpus):
    def broken(question):
        raise OSError("no model")

    assert search.answer(corpus, "alpha", embed, planner).plan.rewrites == ["alpha"]
    found = search.answer(corpus, "where is alpha written?", embed, broken)
    assert found.plan.rewrites == ["where is alpha written?"] and found.hits.count() > 0


def test_archived_documents_and_categories(corpus):
    found = search.answer(corpus, "alpha", embed, include_archived=True)
    assert 4 in {r.doc_id for r in found.hits.collect()}
    some = {r.doc_id for r in search.answer(corpus, "alpha", embed, categories=["y"]).hits.collect()}
    assert some and some <= {2, 5, 6}


def test_what_hits_cite_comes_as_first_windows(corpus):
    found = search.answer(corpus, "alpha", embed, categories=["y"], n=1)
    assert [r.doc_id for r in found.hits.collect()] == [2]
    cited = found.cited.orderBy("distance", "doc_id").collect()
    assert [(r.doc_id, r.distance, r.page_start, r.text) for r in cited] == [(5, 2, 1, "delta\n\nepsilon")]
    every = search.answer(corpus, "alpha", embed, n=3)
    assert all(r.doc_id != 4 for r in every.cited.collect())


def test_hybrid_is_the_chain_of_one_vector(corpus):
    hits = search.hybrid(corpus.index, corpus.embeddings, corpus.documents, "alpha", [1.0, 0.0])
    same = search.answer(corpus, "alpha", lambda texts: [[1.0, 0.0]])
    assert [(r.window_id, round(r.blend, 9)) for r in hits.orderBy("rank").collect()] == [(r.window_id, round(r.blend, 9)) for r in same.hits.orderBy("rank").collect()]
    assert set(hits.select(F.col("lang")).distinct().toPandas()["lang"]) <= {"en", None}
