"""The expiring cache over several runs of one stream."""

import time

import pytest

from tessera.streaming.cache import cached

SCHEMA = "q string, at long, answer string"


def run(spark, tmp_path, data, seconds):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).json(f"file://{tmp_path}/in")
    out = cached(stream, "q", "answer", "at", seconds)
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect() if r["at"] >= data[0][1])


@pytest.fixture(autouse=True)
def settings(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": None, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        if v:
            spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_hits_live_as_long_as_their_entry(spark, tmp_path):
    first = run(spark, tmp_path, [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], 600)
    assert first == [("a", 1, "x", False), ("a", 2, "x", True), ("b", 3, "z", False)]
    assert run(spark, tmp_path, [("a", 4, "new"), ("c", 5, "w")], 600) == [("a", 4, "x", True), ("c", 5, "w", False)]


def test_entries_expire(spark, tmp_path):
    assert run(spark, tmp_path, [("a", 1, "x")], 2) == [("a", 1, "x", False)]
    time.sleep(3)
    assert run(spark, tmp_path, [("a", 2, "y"), ("a", 3, "z")], 2) == [("a", 2, "y", False), ("a", 3, "y", True)]
