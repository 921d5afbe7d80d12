import math

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.common import Scratch
from tessera.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, n long, codes long, component int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, components=16):
    """The contract taken literally, in one place: whole numbers for what is exact, a full covariance for the rest."""
    rows = [(i, v) for i, v in rows if fine(v)]
    long = max(len(v) for _, v in rows)
    codes = [(i, tuple(math.floor(64 * x) + 1_000_000 for x in [*v, *[0.0] * (long - len(v))])) for i, v in rows]
    fit = np.array(sorted({c for _, c in codes}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    out = {}
    for i, c in codes:
        apart = n * np.array(c) - sums
        for k in range(min(components, long)):
            whitened = apart / n @ vectors[:, k] / math.sqrt(values[k]) if values[k] > 1e-9 else None
            out[i, k + 1] = (n, int((apart.astype(object) ** 2).sum()), whitened, values[k] / values.sum())
    return out


def compare(got, wanted):
    assert len(got) == len(wanted)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = wanted[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9, abs=1e-12)
        assert (r.whitened is None) == (whitened is None)
        if whitened is not None and abs(whitened) > 1e-3:
            sign = signs.setdefault(r.component, math.copysign(1, r.whitened * whitened))
            assert sign * r.whitened == pytest.approx(whitened, rel=1e-6, abs=1e-7)
        assert r.identity_error is None or r.identity_error < 1e-9


def test_query_equals_the_plain_covariance(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = QUERIES["op12_whitening"](spark, f"/root/testdata/{sf}").collect()
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
        compare(got, plain([(r.vec_id, r.embedding) for r in table]))


@pytest.mark.parametrize("block,fan", [(3, 2), (2048, 16)])
def test_odd_vectors_and_repeats(spark, block, fan):
    rng = np.random.default_rng(0)
    rows = [(int(i), (rng.normal(0, [1, 2, 3, 0.5], 4) + 5).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 100)]  # a repeated vector counts once
    rows += [(100, None), (101, [None, 1.0, 1.0, 1.0]), (102, [float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [1.0, 2.0, 0.0, 0.0]), (107, [-5.0, 1.0, 1.0, 9.0])]
    docs = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(7)
    compare(whitening.whitened(docs, block=block, fan=fan).collect(), plain(rows))


def test_null_ids_stay_and_repeated_rows_come_out_one_by_one(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [2.0, 3.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and {r.n for r in got} == {3} and sorted(r.vec_id or 0 for r in got) == [0, 0, 1, 1, 1, 1, 2, 2]


def test_components_without_variance_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whitened(same).collect()
    assert len(got) == 10 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whitened(line).collect()}
    assert got[0, 1].explained == 1 and got[0, 2].whitened is None and abs(abs(got[4, 1].whitened) - math.sqrt(2)) < 1e-9
    none = whitening.whitened(same.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_merges_lose_nothing_and_keep_all_dimensions():
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (900, 6)) + 10**12 + rng.integers(0, 2, (900, 1)) * 300
    part = whitening.Part.of(rows[:1])
    for block in np.array_split(rows[1:], 17):
        part = part.merged(whitening.Part.of(block))
    centred = rows - rows.mean(axis=0, dtype=np.longdouble)
    assert part.n == 900 and part.sums.tolist() == rows.sum(axis=0, dtype=object).tolist() and part.basis.shape == (6, 6)
    np.testing.assert_allclose(part.basis.T @ part.basis, (centred.T @ centred).astype(float), rtol=1e-9)


def test_very_large_components_stay_exact(spark):
    rows = [(0, [2.0**50, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1e300])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {2**63 - 1} and all(r.identity_error < 1e-4 for r in got)


def test_parts_are_merged_in_several_rounds(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 1, (400, 3))
    rows = whitening.coded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), "vec_id", "embedding", 64, 1_000_000)
    with Scratch(spark, "t") as scratch:
        fit = whitening.fitted(rows.select("codes").distinct().repartition(30), 3, scratch, 5, 2)
    codes = np.unique(np.floor(64 * vectors).astype(int), axis=0)
    np.testing.assert_allclose(fit.values, np.sort(np.linalg.eigvalsh(np.cov(codes.T, bias=True)))[::-1], rtol=1e-9)
