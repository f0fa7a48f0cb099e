"""Spatial index expressions: spacing, subdivision, child digits, boxes and cells of a tile tree.

A tile's path has a digit 0 to 7 for each level: bit 4 is the upper half in x, bit 2 in y, bit 1 in
z.  A flat tile (height under half of its shorter side) divides in four and keeps its height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tiling rules.
SPACING_DIVISOR = 125.0
FLAT_RATIO = 0.5
SPLIT_COUNT = 20000
LEAST_SPACING = 0.001
BOX = ("x0", "y0", "z0", "x1", "y1", "z1")


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """The box of all points, or of each group."""
    aggs = [F.min(c).alias(f"{c}0") for c in "xyz"] + [F.max(c).alias(f"{c}1") for c in "xyz"]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def diagonal(p: str = "") -> Column:
    return F.expr(f"sqrt(({p}x1 - {p}x0) * ({p}x1 - {p}x0) + ({p}y1 - {p}y0) * ({p}y1 - {p}y0) + ({p}z1 - {p}z0) * ({p}z1 - {p}z0))")


def spacing(p: str = "") -> Column:
    return diagonal(p) / F.lit(SPACING_DIVISOR)


def root_scale(space: Column) -> Column:
    return F.when(space > 10, 0.01).when(space > 1, 0.1).otherwise(1.0)


def is_flat() -> Column:
    """Whether the box x0..z1 divides as a quadtree; a box without width or depth does not."""
    return F.expr("coalesce((z1 - z0) / nullif(least(x1 - x0, y1 - y0), 0D) < 0.5D, false)")


def child_digit() -> Column:
    """The digit of the child of box x0..z1 that holds (x, y, z); an axis without extent gives 0."""
    bit = lambda c: f"case when {c}1 > {c}0 and {c} - ({c}0 + {c}1) / 2D >= 0 then 1 else 0 end"
    return F.expr(f"4 * ({bit('x')}) + 2 * ({bit('y')}) + case when flat then 0 else {bit('z')} end")


def child_box(digit: str = "digit") -> list[Column]:
    """The box of the child with this digit, from x0..z1 and flat."""
    out = []
    for c, b in (("x", 4), ("y", 2), ("z", 1)):
        mid, up = f"({c}0 + {c}1) / 2D", f"({digit} & {b}) <> 0"
        keep = "flat" if c == "z" else "false"
        out.append(F.expr(f"case when {keep} then {c}0 when {up} then {mid} else {c}0 end").alias(f"{c}0"))
        out.append(F.expr(f"case when {keep} then {c}1 when {up} then {c}1 else {mid} end").alias(f"{c}1"))
    return out


def descend(df: DataFrame) -> DataFrame:
    """One level down: df has x, y, z, the box x0..z1 and path; path gets a digit, the box shrinks.

    A column `flat` or `digit` of df is replaced by the level's own and then dropped."""
    keep = [c for c in df.columns if c not in (*BOX, "path", "flat", "digit")]
    df = df.select(*keep, *BOX, "path", is_flat().alias("flat"))
    df = df.select(*keep, *BOX, "path", "flat", child_digit().alias("digit"))
    return df.select(*keep, *child_box(), F.concat("path", F.col("digit").cast("string")).alias("path"))


def with_paths(points: DataFrame, levels: int, box: DataFrame | None = None) -> DataFrame:
    """points with their tile's path of `levels` digits and its box x0..z1.

    box is the root's, one row; by default that of the points."""
    box = bounds(points) if box is None else box.select(*BOX)
    df = points.crossJoin(F.broadcast(box)).withColumn("path", F.lit(""))  # the box is one row
    for _ in range(levels):
        df = descend(df)
    return df


def box_of_path(tiles: DataFrame, root: DataFrame, most: int) -> DataFrame:
    """tiles(path, ...) with the boxes that replaying their digits from the root's box gives; most
    bounds the paths' length."""
    df = tiles.crossJoin(F.broadcast(root.select(*BOX)))
    keep = [c for c in df.columns if c not in BOX]
    for i in range(1, most + 1):
        df = df.withColumn("flat", is_flat()).withColumn("digit", F.substring("path", i, 1).cast("int"))
        moved = [F.when(F.length("path") >= i, c).otherwise(F.col(n)).alias(n) for c, n in zip(child_box(), ("x0", "x1", "y0", "y1", "z0", "z1"), strict=True)]
        df = df.select(*keep, *moved)
    return df


def cell_key(cells: int = 3) -> Column:
    """The grid cell of (x, y, z) in the box x0..z1: `cells` per axis, x in the low bits."""
    n, shift = cells, (cells - 1).bit_length()
    part = lambda c: f"least(greatest(cast(coalesce({n}D * ({c} - {c}0) / nullif({c}1 - {c}0, 0D), 0D) as int), 0), {n - 1})"
    return F.expr(f"{part('x')} + shiftleft({part('y')}, {shift}) + shiftleft({part('z')}, {2 * shift})")


def quadrants(df: DataFrame) -> DataFrame:
    """The four forced quarters of each box, with their digit."""
    df = df.withColumn("flat", F.lit(True)).withColumn("digit", F.explode(F.array(*[F.lit(i) for i in (0, 2, 4, 6)])))
    keep = [c for c in df.columns if c not in (*BOX, "flat")]
    return df.select(*keep, *child_box())


def cubic() -> list[Column]:
    """The box x0..z1 extended to its longest side."""
    side = "greatest(x1 - x0, y1 - y0, z1 - z0)"
    return [F.col(f"{c}0") for c in "xyz"] + [F.expr(f"{c}0 + {side}").alias(f"{c}1") for c in "xyz"]


def morton(bits: int = 15) -> Column:
    """Z-order number of the integer columns ix, iy."""
    terms = [f"shiftleft(cast((shiftright(ix, {i}) & 1) as bigint), {2 * i}) + shiftleft(cast((shiftright(iy, {i}) & 1) as bigint), {2 * i + 1})" for i in range(bits)]
    return F.expr(" + ".join(terms))


def tile_file(path: str = "path") -> Column:
    """The content file of a tile: folders of eight digits, then r, the rest and .pnts."""
    k = f"(8 * cast(floor(greatest(length({path}) - 1, 0) / 8) as int))"
    return F.expr(f"concat(regexp_replace(substring({path}, 1, {k}), '(.{{8}})', '$1/'), 'r', substring({path}, {k} + 1), '.pnts')")


def geometric_error(space: Column, scale: Column, path: str = "path") -> Column:
    """Ten times the tile's spacing, which halves at the root and at each level, in file units."""
    return F.lit(10.0) * space / F.pow(F.lit(2.0), F.length(path) + 1) / scale


def volume() -> Column:
    """The 3D Tiles box of x0..z1: centre and three half axes."""
    mid = [F.expr(f"({c}0 + {c}1) / 2D") for c in "xyz"]
    half = [F.expr(f"({c}1 - {c}0) / 2D") for c in "xyz"]
    zero = F.lit(0.0)
    return F.array(*mid, half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])
