"""Text point clouds: a point a line, fields separated by spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(line: Column | str = "value") -> list[Column]:
    """x, y, z, intensity, r, g, b of a line of 3 (x y z), 4 (x y z i), 6 (x y z r g b) or 7
    (x y z i r g b) fields.  Other lines, and fields that are not numbers, give nulls."""
    line = F.col(line) if isinstance(line, str) else line
    f = F.split(F.trim(line), " +")
    n = F.size(f)
    known = n.isin(3, 4, 6, 7)
    num = lambda i: F.when(known, F.try_element_at(f, i).try_cast("double"))
    color = lambda i: F.when(n.isin(6, 7), F.try_element_at(f, F.lit(i)).try_cast("double").cast("int"))
    return [
        *[num(F.lit(i + 1)).alias(c) for i, c in enumerate("xyz")],
        F.when(n.isin(4, 7), F.try_element_at(f, F.lit(4)).try_cast("double")).alias("intensity"),
        *[color(i).alias(c) for i, c in ((-3, "r"), (-2, "g"), (-1, "b"))],
    ]


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """points(src, seq, x, y, z, r, g, b); lines that are not points are left out.

    seq orders lines within a file by where they lie; it is not dense."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("src"), F.monotonically_increasing_id().alias("seq"))
    out = lines.select("src", "seq", *parse())
    out = out.where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)")
    return out.select("src", "seq", "x", "y", "z", *[F.coalesce(c, F.col("intensity").cast("int"), F.lit(0)).alias(c) for c in "rgb"])


def metadata(points: DataFrame) -> DataFrame:
    """(src, n, box) of each file."""
    from voxelith.functions import index

    return points.groupBy("src").agg(F.count("*").alias("n"), *[F.min(c).alias(f"{c}0") for c in "xyz"], *[F.max(c).alias(f"{c}1") for c in "xyz"]).select("src", "n", *index.BOX)
