"""The point clouds that the registered queries read: views of the shared tables as (seq keys, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """lineitem as an octree cloud."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.col("l_extendedprice").alias("x"), F.col("l_partkey").cast("double").alias("y"), (F.col("l_quantity") * 1000).alias("z"), *extra)


def p1q(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """lineitem as a flat cloud, which a quadtree divides."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.col("l_extendedprice").alias("x"), (F.col("l_partkey").cast("double") * 10).alias("y"), F.col("l_quantity").alias("z"), *extra)


def p2(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """events in hours, users and values."""
    d = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("double") / 1e6 / 3600
    return d.select(hours.alias("x"), (F.col("user_id").cast("double") * 100).alias("y"), (F.col("value") / 10).alias("z"), *extra)


def p3(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The first three elements of the embeddings."""
    d = table(spark, sf_dir, "embeddings")
    return d.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], *extra)


#: The same views for DuckDB.
CLOUD_SQL = {
    "p1": "select l_extendedprice as x, cast(l_partkey as double) as y, l_quantity * 1000 as z from lineitem",
    "p1q": "select l_extendedprice as x, cast(l_partkey as double) * 10 as y, l_quantity as z from lineitem",
    "p2": "select cast(epoch_us(ts) as double) / cast('1e6' as double) / 3600 as x, cast(user_id as double) * 100 as y, value / 10 as z from events",
    "p3": "select cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings",
}
