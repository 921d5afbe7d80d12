import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tessera-test-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tessera-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Runs a registered query and its SQL over a folder of tables and compares the rows."""
    import datetime
    import decimal
    import math

    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def plain(v):
        if isinstance(v, bool):
            return v
        if isinstance(v, decimal.Decimal):
            return float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        return v

    def compare(frame, sql, sf_dir):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        relation = con.sql(sql)
        names = sorted(frame.columns)
        assert names == sorted(relation.columns)
        at = [relation.columns.index(n) for n in names]
        got = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
        wanted = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
        assert got == wanted

    return compare
