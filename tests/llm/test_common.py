import pytest

from voxelith.llm import common
from voxelith.operators import tables


def test_hot_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(4000)], "i long, k long")
    keys = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as v")
    for total in (4000, 10**9, 0):  # one hot key, none, all
        got = common.hot_join(rows, keys, "k", "n", total)
        assert sorted(map(tuple, got.select("i", "k", "v").collect())) == [(i, k, 2 * k) for i, k in ((i, 7 if i % 2 else i) for i in range(4000))]
    assert common.hot_join(rows, keys.where("k = 7"), "k", "n", 4000).count() == 2000
    assert common.hot_join(rows.limit(0), keys, "k", "n", 4000).count() == 0


def test_batches_of_fewer_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.fewer_bytes(spark, 12345):
        assert spark.conf.get(key) == "12345"
    assert spark.conf.get(key) == before


def test_tables_are_written_and_deleted(spark):
    t = common.materialize(spark.range(5), "t")
    assert t.count() == 5 and "/voxelith/t-" in t.scratch_path
    common.discard(t, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t.scratch_path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        tables.scratch(Session(), "t")
