"""A stream that is stopped anywhere and started again leaves every row once."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.lake import Table
from tessera.streaming import exact

SCHEMA = "id long, v string"


def rules():
    return {"no id": F.col("id").isNotNull(), "no value": F.length("v") > 0}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture
def place(spark, tmp_path):
    top = f"file://{tmp_path}"
    table = Table.create(spark, f"{top}/t", "id", spark.createDataFrame([], SCHEMA).schema, buckets=4)
    return top, table, exact.dead_letters(spark, f"{top}/dead", 4)


def feed(spark, top, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").json(f"{top}/in")


def run(spark, place):
    top, table, dead = place
    exact.ingest(spark.readStream.schema(SCHEMA).json(f"{top}/in"), "w", table, dead, rules(), f"{top}/check").awaitTermination()


@pytest.mark.parametrize("stop", ["first", "second", "end"])
def test_a_stop_between_write_and_checkpoint(spark, place, monkeypatch, stop):
    top, table, dead = place
    feed(spark, top, [(1, "a"), (2, "b"), (None, "x"), (3, "")])
    real, calls = Table.upsert, []

    def upsert(self, *args, **more):
        if stop == "first" and not calls:
            calls.append(1)
            raise RuntimeError("lost before the first commit")
        out = real(self, *args, **more)
        if not calls and (self.path == table.path) == (stop == "second"):
            calls.append(1)
            raise RuntimeError("lost after a commit")
        return out

    monkeypatch.setattr(Table, "upsert", upsert)
    with pytest.raises(Exception, match="lost"):
        run(spark, place)
    run(spark, place)
    assert rows(table.read()) == [(1, "a"), (2, "b")]
    assert sorted((r.reason, r.tries) for r in dead.read().collect()) == [("no id", 1), ("no value", 1)]
    assert [h["batch"] for h in table.history()].count({"w": 0}) == 1
    feed(spark, top, [(2, "later"), (4, "d")])
    run(spark, place)
    assert rows(table.read()) == [(1, "a"), (2, "later"), (4, "d")]


def test_dead_letters_are_tried_again_and_given_up(spark, place):
    top, table, dead = place
    feed(spark, top, [(7, ""), (8, "")])
    run(spark, place)
    schema = table.read().schema
    milder = {"no id": F.col("id").isNotNull(), "not eight": F.col("id") != 8}
    assert exact.retried(table, dead, schema, milder) == 1
    assert rows(table.read()) == [(7, "")]
    assert [(r.reason, r.tries, r.given_up) for r in dead.read().collect()] == [("not eight", 2, False)]
    assert exact.retried(table, dead, schema, milder) == 0
    assert [(r.tries, r.given_up) for r in dead.read().collect()] == [(3, True)]
    exact.retried(table, dead, schema, {"none": F.lit(True)})
    assert rows(table.read()) == [(7, "")]
