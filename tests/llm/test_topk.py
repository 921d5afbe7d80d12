import random

import numpy as np
import pytest

from tessera.llm import topk
from tessera.llm.queries import QUERIES, SQL


def test_search_and_its_sql(spark, same):
    same(QUERIES["op5_topk_search"](spark, "/root/testdata/sf0.01"), SQL["op5_topk_search"], "/root/testdata/sf0.01")


def plain(rows, k, every):
    sound = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        own = min(v for i, v in sound if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in sound if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("block,group,pivots", [(4, 2, 3), (256, 4096, 256)])
def test_ties_nulls_and_odd_vectors(spark, block, group, pivots):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(40)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(40, 60)]
    rows += [(60, None), (61, [None, 1.0, 1.0]), (62, [float("nan"), 1.0, 1.0]), (63, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (64, []), (65, [0.25]), (66, [0.1, 0.2, 0.3, 0.4]), (10, [0.9, 0.9, 0.9]), (10, [0.9, 0.9, 0.9])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(docs, 5, 10, block=block, group=group, pivots=pivots).collect())
    assert got == plain(rows, 5, 10)
    assert topk.top_k(docs.limit(0), 5, 10).count() == 0


def test_pruning_skips_blocks_and_changes_nothing():
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(20):
        codes = rng.integers(-20, 20, (50, 8)) + (200 if b == 3 else 0)
        blocks.append((np.arange(50) + 1000 * b, codes, codes.max(axis=0), codes.min(axis=0)))
    queries = rng.integers(1, 50, (6, 8))
    found, pruned = topk.search(queries, np.arange(6) + 10**6, blocks, 5)
    everything = [(i, c) for ids, codes, *_ in blocks for i, c in zip(ids.tolist(), codes)]
    for q, query in enumerate(queries):
        wanted = sorted((-int(query @ c), i) for i, c in everything)[:5]
        assert [(-s, i) for who, i, s in found if who == q + 10**6] == wanted
    assert pruned >= 6 * 18


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 2.0**-8]), (2, [2.0**20, 0.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()]
    assert got == [(1, 2**56 + 256), (2, 2**56)]


def test_components_and_scores_beyond_64_bits_are_held_at_the_bounds(spark):
    rows = [(0, [1e300, -1e300]), (1, [1.0, 1.0]), (2, [-1e300, 1.0]), (3, [1e300, 0.0]), (4, [2.0**54, -(2.0**54)])]
    got = [(r.vec_id, r.score) for r in sorted(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"])]
    most, least = 2**63 - 1, -(2**63)
    # 1: 256 * most + 256 * least = -256
    assert got == [(3, most), (4, most), (1, -256), (2, least)]
    a, b = np.array([[least, 3]]), np.array([[1, 2**40 + 1]])
    assert topk._product(a, b)[0, 0] == least + 3 * (2**40 + 1)


def test_crowded_directions_are_pruned(spark):
    """Blocks of rows of one direction have tight bounds: most visits are saved."""
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 1, (20, 16))
    vectors = np.concatenate([c + rng.normal(0, 0.05, (100, 16)) for c in centers])
    rows = spark.createDataFrame([(i, np.floor(256 * v).astype(int).tolist()) for i, v in enumerate(vectors[rng.permutation(len(vectors))])], "id long, codes array<long>")
    blocks, ids, codes = topk.index(rows, 50, 100)
    index = [topk._read(r.asDict(), 16) for r in blocks.collect()]
    assert sorted(i for b in index for i in b[0]) == list(range(2000))
    queries = np.array([r.codes for r in rows.filter("id % 50 = 0").orderBy("id").collect()])
    asked = np.arange(0, 2000, 50)
    found, pruned = topk.search(queries, asked, index, 5, topk._floors(queries, asked, ids, codes, 5))
    assert pruned > 0.6 * len(queries) * len(index)
    every = sorted((-int(queries[0] @ c), int(i)) for b in index for i, c in zip(b[0], b[1]) if i != 0)[:5]
    assert [(-s, i) for who, i, s in found if who == 0] == every
