import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives
from tessera.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, at long, score long"


def test_query_and_its_sql(spark, same):
    for sf in ("sf0.001", "sf0.01"):
        same(QUERIES["op13_hard_negatives"](spark, f"/root/testdata/{sf}"), SQL["op13_hard_negatives"], f"/root/testdata/{sf}")


def plain(rows, every, n_positives, n_negatives):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, _, _ in fine if i % every == 0}):
        own, label = min((v, lab) for i, v, lab in fine if i == anchor)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i, lab) for i, v, lab in fine if i != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == label][:n_positives]:
            fit = [(s, i) for s, i, lab in scored if lab != label and 50 * -minus <= 100 * -s <= 95 * -minus]
            out += [(anchor, positive, r, i, -minus, -s) for r, (s, i) in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(3, 2), (4096, 16384)])
def test_ties_nulls_and_odd_vectors(spark, block, group):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-0.2, 1) for _ in range(3)], rng.randrange(3)) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5], i % 2) for i in range(120, 150)]  # ties
    rows += [(150, None, 1), (160, [None, 1.0, 1.0], 1), (170, [float("nan"), 1.0, 1.0], 1), (180, [float("inf"), 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (190, [1.0, 1.0, 1.0], None)]
    rows += [(200, [], 1), (201, [0.25], 1), (210, [0.1, 0.2, 0.3, 0.4], 0), (10, [0.9, 0.9, 0.9], 2), (11, [0.9, 0.9, 0.9], 0), (11, [0.9, 0.9, 0.9], 0), (220, [-1.0, -1.0, -1.0], 5)]
    docs = spark.createDataFrame([(i, v, lab, 1, 2, 3) for i, v, lab in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mined(docs, 4, 3, 10, block=block, group=group).collect())
    assert got == plain(rows, 10, 4, 3) and len(got) > 50


def test_empty_table(spark):
    none = hard_negatives.mined(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and none.count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = random.Random(4)
    rows = [(i, [0.5, 0.25] if i % 3 else [rng.uniform(0, 1), rng.uniform(0, 1)], i % 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1))
    got = sorted(tuple(r) for r in hard_negatives.mined(docs, block=16).collect())
    assert got == plain([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 50, 5, 3)
