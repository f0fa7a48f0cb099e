"""What the operators of this subpackage share: scratch tables, words, bounded broadcasts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.tables import discard, materialize, scratch

__all__ = ["discard", "fewer_bytes", "hot_join", "materialize", "partitions", "scratch", "words"]

#: Characters that separate words: space and U+0009 to U+000D.
WORD_BREAK = r"[ \t-\r]+"
#: A key is hot if it has over one row in so many; so there are fewer hot keys than this.
HOT_SHARE = 1000


def words(text: Column) -> Column:
    """array<string> of the words `[^\\x20\\x09-\\x0D]+` of text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


@contextmanager
def fewer_bytes(spark: SparkSession, most: int = 8 << 20):
    """Within this block, Arrow batches to Python end at about `most` bytes, not at 64 MB: a batch is
    held by the JVM, outside its heap, and by the Python worker, for each task that runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def hot_join(rows: DataFrame, keys: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """rows joined with keys(on, count, ...), which has one row for each value of `on` in rows and in
    `count` its number of rows, out of `total`.

    Keys of over total / HOT_SHARE rows are fewer than HOT_SHARE, whatever the input, and are
    broadcast; all others go by shuffle, where none is large."""
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    few = keys.where(hot)
    rest = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(keys.where(~hot), on)
    return rows.join(F.broadcast(few), on).unionByName(rest).drop(count)
