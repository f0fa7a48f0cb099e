"""Tiles as relations: statistics, hierarchy joins and rollups, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions import index


def tile_stats(pathed: DataFrame) -> DataFrame:
    """(path, n, x0..z1): points and tight box of each tile."""
    tight = [F.min(c).alias(f"{c}0") for c in "xyz"] + [F.max(c).alias(f"{c}1") for c in "xyz"]
    return pathed.select("path", "x", "y", "z").groupBy("path").agg(F.count("*").alias("n"), *tight)


def metadata(points: DataFrame) -> DataFrame:
    """One row: the box, its root spacing, the scale that the spacing asks for, the subdivision."""
    box = index.bounds(points)
    out = box.withColumn("spacing", index.spacing()).withColumn("scale", index.root_scale(F.col("spacing")))
    return out.withColumn("subdivision", F.when(index.is_flat(), "QUADTREE").otherwise("OCTREE"))


def ancestors(tiles: DataFrame) -> DataFrame:
    """tiles with `ancestor`: a row for each prefix of path, itself and the root included."""
    return tiles.withColumn("ancestor", F.explode(F.expr("transform(sequence(0, length(path)), i -> substring(path, 1, i))")))


def rollup(tiles: DataFrame) -> DataFrame:
    """(path, n, x0..z1) of every tile above and at tiles(path, n, x0..z1)."""
    up = ancestors(tiles)
    boxes = [F.min(f"{c}0").alias(f"{c}0") for c in "xyz"] + [F.max(f"{c}1").alias(f"{c}1") for c in "xyz"]
    return up.groupBy(F.col("ancestor").alias("path")).agg(F.sum("n").alias("n"), *boxes)


def ancestor_join(tiles: DataFrame, above: DataFrame) -> DataFrame:
    """(path, ancestor) pairs where above(path) is a proper prefix of tiles(path)."""
    up = ancestors(tiles.select("path")).where("ancestor <> path")
    return up.join(above.select(F.col("path").alias("ancestor")).distinct(), "ancestor").select("path", "ancestor")


def with_parent(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("parent", F.expr("case when path <> '' then substring(path, 1, length(path) - 1) end"))


def parent_child(tiles: DataFrame) -> DataFrame:
    """(parent, path, n, parent_n)"""
    top = tiles.select(F.col("path").alias("parent"), F.col("n").alias("parent_n"))
    return with_parent(tiles.select("path", "n")).join(top, "parent").select("parent", "path", "n", "parent_n")


def internal(tiles: DataFrame) -> DataFrame:
    """The tiles that have a child."""
    kids = with_parent(tiles.select("path")).select(F.col("parent").alias("path"))
    return tiles.join(kids, "path", "left_semi")


def leaves(tiles: DataFrame) -> DataFrame:
    kids = with_parent(tiles.select("path")).select(F.col("parent").alias("path"))
    return tiles.join(kids, "path", "left_anti")


def split_kinds(points: DataFrame, threshold: int = index.SPLIT_COUNT) -> DataFrame:
    """(path, n, is_leaf) of the level-1 tiles: a tile divides from `threshold` points on while its
    spacing exceeds a thousandth of the scale."""
    meta = metadata(points)
    tiles = index.with_paths(points, 1).groupBy("path").agg(F.count("*").alias("n"))
    both = tiles.crossJoin(F.broadcast(meta.select("spacing", "scale")))
    fine = F.col("spacing") * F.col("scale") / 2 <= index.LEAST_SPACING * F.col("scale")
    return both.select("path", "n", ((F.col("n") < threshold) | fine).alias("is_leaf"))


def compact(tiles: DataFrame, least: int = 100) -> DataFrame:
    """tiles(path, n): those of fewer than `least` points go into their parent, from the deepest
    level up.  Gives (path, n, target), target being the tile that holds the points now.

    The root takes what is left and is never folded."""
    from voxelith.operators.tables import materialize

    # A table of its own: conditions on path are not pushed into what computes paths.
    tiles = materialize(tiles.select("path", "n"), "tiles")
    most = tiles.agg(F.max(F.length("path"))).first()[0] or 0
    now = tiles.groupBy("path").agg(F.sum("n").alias("n"))
    moves = tiles.select("path", F.col("n"), F.col("path").alias("target"))
    for depth in range(most, 0, -1):
        at = (F.length("path") == depth) & (F.col("n") < least)
        folded = now.where(at).select("path")
        now = now.withColumn("path", F.when(at, F.expr("substring(path, 1, length(path) - 1)")).otherwise(F.col("path")))
        now = materialize(now.groupBy("path").agg(F.sum("n").alias("n")), "tiles")
        moves = moves.join(folded.select(F.col("path").alias("target"), F.lit(True).alias("up")), "target", "left")
        moves = materialize(moves.select("path", "n", F.expr("case when up then substring(target, 1, length(target) - 1) else target end").alias("target")), "moves")
    return moves


def overview_sample(points: DataFrame, by: str, most: int = 50000, order: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Of each group the first floor(n * ratio) rows in `order`, ratio being at most a half and such
    that about `most` rows are taken in all.  Deterministic, without replacement."""
    n = points.groupBy(by).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    share = n.crossJoin(F.broadcast(total)).select(by, F.expr(f"cast(floor(_n * least(0.5D, {float(most)}D / _total)) as bigint)").alias("_take"))
    ranked = points.join(share, by).withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where("_rank <= _take").drop("_rank", "_take")


def voxel_first(points: DataFrame, size: float, order: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The first point of each cube of edge `size`: a relaxation of the spacing rule that needs no
    window, only a partial aggregate."""
    cube = [F.floor(F.col(c) / F.lit(size)).cast("long").alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*cube).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).select("vx", "vy", "vz", "first.*", "n")


def prune_box(tiles: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """The tiles whose tight box meets the box low..high: plain comparisons, which Parquet prunes by."""
    cond = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        cond = cond & (F.col(f"{c}0") <= b) & (F.col(f"{c}1") >= a)
    return tiles.where(cond)
