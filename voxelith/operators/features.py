"""Polygon features over a grid: containment by equi-key, quadtree levels by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions import index
from voxelith.operators.tables import materialize

#: Edge of a root cell and features kept at a node.
CELL, KEEP = 2000.0, 20


def grid_cell(features: DataFrame, size: float = CELL) -> DataFrame:
    """features(fid, x0..z1, ...) with the grid cell i, j of their centre.  The cell is computed, so
    features and cells join by key and no pair is tested; the upper border belongs to the last cell."""
    ext = features.agg(*[F.min(f"{c}0").alias(f"_{c}0") for c in "xy"], *[F.max(f"{c}1").alias(f"_{c}1") for c in "xy"])
    both = features.crossJoin(F.broadcast(ext))  # one row
    cell = lambda c: F.expr(f"cast(least(floor((({c}0 + {c}1) / 2D - _{c}0) / {size}D), greatest(ceil((_{c}1 - _{c}0) / {size}D), 1) - 1) as int)")
    return both.withColumn("i", cell("x")).withColumn("j", cell("y")).drop("_x0", "_x1", "_y0", "_y1")


def contained(features: DataFrame, size: float = CELL) -> DataFrame:
    """(i, j, n, weight): features of each cell."""
    return grid_cell(features, size).groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def assign(features: DataFrame, keep: int = KEEP, size: float = CELL, most: int = 10) -> DataFrame:
    """features with node: the cell, and the quarter digits at which the feature is among the
    `keep` heaviest that are left; fid is unique.  At depth `most` a node keeps all."""
    own = features.columns
    cells = grid_cell(features, size)
    ext = features.agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"))
    todo = cells.crossJoin(F.broadcast(ext))
    todo = todo.withColumn("_cx", F.expr("(x0 + x1) / 2D")).withColumn("_cy", F.expr("(y0 + y1) / 2D"))
    todo = todo.withColumn("_u", F.expr(f"_x + i * {size}D")).withColumn("_v", F.expr(f"_y + j * {size}D")).withColumn("node", F.format_string("%d_%d", "i", "j"))
    side, done = size, None
    for depth in range(most + 1):
        todo = materialize(todo, "features")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "fid"))
        # A rank with a limit keeps `keep` rows of a node in each task before the shuffle.
        here = todo if depth == most else materialize(todo.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank"), "heaviest")
        done_here = here.select(*own, "node", F.lit(depth).alias("depth"))
        done = done_here if done is None else done.unionByName(done_here)
        if depth == most:
            break
        todo = todo.join(here.select("fid"), "fid", "left_anti")
        if not todo.take(1):
            break
        side /= 2
        right, up = F.col("_cx") >= F.col("_u") + side, F.col("_cy") >= F.col("_v") + side
        digit = F.when(right, 2).otherwise(0) + F.when(up, 1).otherwise(0)
        todo = todo.withColumn("node", F.concat("node", F.when(F.lit(depth == 0), F.lit("_")).otherwise(F.lit("")), digit.cast("string")))
        todo = todo.withColumn("_u", F.when(right, F.col("_u") + side).otherwise(F.col("_u"))).withColumn("_v", F.when(up, F.col("_v") + side).otherwise(F.col("_v")))
    return done


def node_boxes(assigned: DataFrame) -> DataFrame:
    """(node, x0..z1) of nodes with everything below them."""
    parts = F.expr("transform(sequence(0, greatest(length(node) - length(substring_index(node, '_', 2)) - 1, 0)), k -> case when k = 0 then substring_index(node, '_', 2) else concat(substring_index(node, '_', 2), '_', substring(substring_index(node, '_', -1), 1, k)) end)")
    up = assigned.withColumn("node", F.explode(parts))
    return up.groupBy("node").agg(*[F.min(f"{c}0").alias(f"{c}0") for c in "xyz"], *[F.max(f"{c}1").alias(f"{c}1") for c in "xyz"]).select("node", *index.BOX)


def swap_up(df: DataFrame) -> DataFrame:
    """Boxes with y up as boxes with z up: (x, -z, y)."""
    return df.withColumns({"y0": -F.col("z1"), "y1": -F.col("z0"), "z0": F.col("y0"), "z1": F.col("y1")})


def ring_areas(points: DataFrame, ring: str, order: str) -> DataFrame:
    """(ring, area): the signed area of each ring of points(x, y) in `order`, by neighbouring pairs
    and the pair that closes the ring."""
    w = Window.partitionBy(ring).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y")]
    terms = points.withColumn("_t", F.col("x") * nxt[1] - nxt[0] * F.col("y"))
    return terms.groupBy(ring).agg((F.sum("_t") / 2).alias("area"))


def byte_offsets(parts: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """parts with `offset`: the bytes of the group's parts before this one."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def in_triangle(x: str, y: str, corners: list[tuple[float, float]]) -> F.Column:
    """Whether the point is in the closed triangle."""
    signs = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        signs.append((F.lit(float(bx - ax)) * (F.col(y) - F.lit(float(ay))) - F.lit(float(by - ay)) * (F.col(x) - F.lit(float(ax)))))
    return ((signs[0] >= 0) & (signs[1] >= 0) & (signs[2] >= 0)) | ((signs[0] <= 0) & (signs[1] <= 0) & (signs[2] <= 0))


def inside(x: str, y: str, low: tuple[float, float], high: tuple[float, float]) -> F.Column:
    """Half open: the lower borders belong to the box, the upper ones do not."""
    return (F.col(x) >= low[0]) & (F.col(x) < high[0]) & (F.col(y) >= low[1]) & (F.col(y) < high[1])
