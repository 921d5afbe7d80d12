"""The vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_index, vectors
from tessera.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (30, 80))
    data = np.concatenate([centres[i % 30] + rng.normal(0, 0.6, 80) for i in range(1200)]).reshape(1200, 80)
    made = [(i, v.tolist()) for i, v in enumerate(data)] + [(1200, None), (None, [1.0] * 80), (1201, [0.0] * 80)]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return VectorIndex.build(rows, f"file://{tmp_path_factory.mktemp('vi')}/i", k=10)


def asked(rows):
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def test_recall_and_exact_scores(rows, index):
    found = index.top_k(asked(rows), 10)
    exact = vectors.batch_top_k(rows.filter("vec_id IS NOT NULL"), asked(rows).filter("qvec IS NOT NULL"), 10).withColumnRenamed("vec_id", "id")
    assert vector_index.recall(found, exact).first().recall >= 0.9
    scores = {(r.qid, r.id): r.score for r in exact.collect()}
    both = [r for r in found.collect() if (r.qid, r.id) in scores]
    assert both and all(r.score == pytest.approx(scores[r.qid, r.id]) for r in both)
    assert 1 <= index.facts.probes < len(index.facts.centres) and index.facts.pool < 1200


def test_every_row_is_in_one_list(rows, index):
    ids = sorted(r.id for r in index.lists().select("id").collect())
    assert ids == sorted(r.vec_id for r in rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id").collect())


def test_all_cells_and_all_rows_are_brute_force(rows, index):
    again = VectorIndex.open(index.spark, index.path)
    assert again.facts == index.facts
    found = {(r.qid, r["rank"], r.id) for r in again.top_k(asked(rows), 10, probes=10_000, pool=10_000).collect()}
    exact = {(r.qid, r["rank"], r.vec_id) for r in vectors.batch_top_k(rows.filter("vec_id IS NOT NULL"), asked(rows).filter("qvec IS NOT NULL"), 10).collect()}
    assert found == exact


def test_only_probed_cells_are_kept_apart(index):
    plan = index.lists().filter("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_pool_cut_takes_ties_whole(spark):
    pairs = spark.createDataFrame([(1, 3), (1, 3), (1, 5), (1, 9), (2, 7)], "qid int, apart int")
    assert {r.qid: r.cut for r in vector_index.within_pool(pairs, 2).collect()} == {1: 3, 2: 7}
    assert {r.qid: r.cut for r in vector_index.within_pool(pairs, 3).collect()} == {1: 5, 2: 7}


def test_other_lengths_are_errors(spark, index):
    with pytest.raises(Exception, match="length 80"):
        index.top_k(spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>")).collect()
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), "file:///tmp/none")


def test_recall_holds_beyond_the_sample(spark, tmp_path):
    """A pool is a share of all rows, not as many as the sample needed."""
    data = np.random.default_rng(6).normal(0, 1, (3000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    made = VectorIndex.build(table, f"file://{tmp_path}/i", k=10, sample=300)
    exact = vectors.batch_top_k(table, asked(table), 10).withColumnRenamed("vec_id", "id")
    assert vector_index.recall(made.top_k(asked(table), 10), exact).first().recall >= 0.9


def test_questions_are_sent_and_rows_are_not_joined(rows, index, monkeypatch):
    plan = index.top_k(asked(rows), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    whole = sorted(map(tuple, index.top_k(asked(rows), 10).collect()))
    monkeypatch.setattr(vector_index, "BATCH", 5)
    monkeypatch.setattr(vector_index, "PRODUCTS", 7)
    assert whole and sorted(map(tuple, index.top_k(asked(rows), 10).collect())) == whole


def test_a_cell_is_a_file_not_one_for_each_task(index):
    cells = index.lists().select("cell").distinct().count()
    assert len(index.lists().inputFiles()) == cells > 4
