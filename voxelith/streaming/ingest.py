"""Point streams: tile counts as points arrive, and tiles that are complete by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions import index


def with_paths(stream: DataFrame, box: dict[str, float], levels: int) -> DataFrame:
    """Points of a stream with their tile's path; the root's box is known beforehand."""
    df = stream.withColumns({k: F.lit(float(box[k])) for k in index.BOX}).withColumn("path", F.lit(""))
    for _ in range(levels):
        df = index.descend(df)
    return df


def running_counts(stream: DataFrame, box: dict[str, float], levels: int) -> DataFrame:
    """(path, n, box) so far; for update or complete output."""
    return with_paths(stream, box, levels).groupBy("path").agg(F.count("*").alias("n"), *[F.min(c).alias(f"{c}0") for c in "xyz"], *[F.max(c).alias(f"{c}1") for c in "xyz"])


def complete_tiles(stream: DataFrame, box: dict[str, float], levels: int, time: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window, path, n): a tile of a window goes out once, when the watermark has passed it, so
    that no point of it can come any more; for append output."""
    df = with_paths(stream.withWatermark(time, late), box, levels)
    return df.groupBy(F.window(time, window), "path").agg(F.count("*").alias("n"))
