"""Point cloud to tileset: read, reproject, scale, build levels, encode, write."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import crs, index, linalg
from voxelith.operators import lod, tiling
from voxelith.operators.tables import materialize
from voxelith.sources import las, tiles, xyz


@dataclass
class Options:
    """What `convert` can be told."""

    srs_in: str | None = None
    srs_out: str | None = None
    fraction: int = 100
    rgb: bool = True
    overwrite: bool = False
    threshold: int = index.SPLIT_COUNT
    compact: int = 100
    color_scale: float | None = None


def read_points(spark: SparkSession, files: list[str]) -> DataFrame:
    """points(src, seq, x, y, z, r, g, b) of LAS and XYZ files, by suffix."""
    parts = []
    for f in files:
        parts.append(las.read_las(spark, f) if f.lower().endswith(".las") else xyz.read_xyz(spark, f))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fraction(points: DataFrame, percent: int, *keys: str) -> DataFrame:
    """About `percent` of a hundred points, chosen by a hash of keys: the same ones each time, by any
    program (the first eight digits of an MD5)."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8)
    return points if percent >= 100 else points.where(F.conv(digits, 16, 10).cast("long") % 100 < percent)


def alignment(corners: list[np.ndarray]) -> np.ndarray:
    """For geocentric clouds: the rotation that turns the ground's normal to z and its bottom edge
    to x, from bottom left, top right and bottom right corners."""
    left, top, right = corners
    up = np.cross(right - left, top - left)
    if linalg.vector_norm(up) < 1e-9:  # no ground to speak of
        return np.eye(4)
    up = linalg.unit_vector(up)
    if up @ left < 0:
        up = -up
    turn = linalg.rotation_matrix(linalg.angle_between_vectors(up, [0, 0, 1]), np.cross(up, [0, 0, 1])) if not np.allclose(up, [0, 0, 1]) else np.eye(4)
    x = turn[:3, :3] @ (right - left)
    return linalg.rotation_matrix(-np.arctan2(x[1], x[0]), [0, 0, 1]) @ turn


def prepare(points: DataFrame, options: Options) -> tuple[DataFrame, dict]:
    """Points in the tileset's own frame, and its offset, rotation, scale and root spacing.

    The offset is the least corner; the scale comes from the spacing, so that tile coordinates stay
    small."""
    if options.srs_out and not options.srs_in:
        raise crs.SourceSystemMissing("a target system needs a source system")
    points = fraction(points, options.fraction, "src", "seq")
    if options.color_scale is not None:
        points = points.withColumns({c: F.pmod((F.col(c) * options.color_scale).cast("long"), F.lit(256)).cast("int") for c in "rgb"})
    flat = index.bounds(points).first()
    turn = np.eye(4)
    if options.srs_out:
        moved = crs.reproject(F.col("x"), F.col("y"), F.col("z"), options.srs_in, options.srs_out)
        points = points.withColumns(dict(zip("xyz", moved, strict=True)))
        if str(options.srs_out) == "4978" and flat["x0"] is not None:
            spark = points.sparkSession
            three = spark.createDataFrame([(flat["x0"], flat["y0"], flat["z0"]), (flat["x1"], flat["y1"], flat["z0"]), (flat["x1"], flat["y0"], flat["z0"])], "x double, y double, z double")
            at = three.select(*[c.alias(n) for c, n in zip(crs.reproject(F.col("x"), F.col("y"), F.col("z"), options.srs_in, "4978"), "xyz", strict=True)]).collect()
            turn = alignment([np.array(r) for r in at])
    points = materialize(points, "points")
    box = index.bounds(points).first()
    offset = np.array([box[f"{c}0"] or 0.0 for c in "xyz"])
    step = np.eye(4)
    step[:3, 3] = -offset
    points = points.withColumns(dict(zip("xyz", linalg.transform_point(turn @ step), strict=True)))
    meta = tiling.metadata(points).first()
    scale, spacing = meta["scale"], (meta["spacing"] or 0.0) * meta["scale"]
    points = points.withColumns({c: F.col(c) * scale for c in "xyz"})
    back = linalg.concatenate_matrices(linalg.translation_matrix(offset), linalg.scale_matrix(1 / scale), linalg.inverse_matrix(turn))
    return points, {"offset": offset, "scale": scale, "spacing": spacing, "transform": back}


def convert_points(points: DataFrame, folder: str, options: Options | None = None) -> dict:
    """Write points as a tileset in folder; returns the numbers of points and tiles."""
    options = options or Options()
    guard(folder, options.overwrite)
    points, meta = prepare(points, options)
    tiled = materialize(lod.build(points, options.threshold, order=("src", "seq"), scale=meta["scale"]), "tiled")
    counts = materialize(tiling.tile_stats(tiled), "counts")
    targets = materialize(tiling.compact(counts, options.compact).select("path", "target"), "targets")
    placed = tiled.join(targets.where("target <> ''"), "path").drop("path").withColumnRenamed("target", "path")
    content = tiles.encode_tiles(placed, ("src", "seq"), options.rgb)
    written = materialize(tiles.write_files(content.select(tiles.part_name(index.tile_file(), F.col("part")).alias("name"), "content"), folder), "written")
    top = lod.overview(tiled.select("src", "seq", "x", "y", "z", "r", "g", "b", "path", "depth"), meta["spacing"], ("src", "seq"))
    rest = tiled.join(targets.where("target = ''"), "path", "left_semi").select(*top.columns)  # what was folded into the root
    top = top.unionByName(rest).dropDuplicates(["src", "seq"]).withColumn("path", F.lit(""))
    root = tiles.encode_tiles(top, ("src", "seq"), options.rgb)
    heads = tiles.write_files(root.select(tiles.part_name(F.lit("r.pnts"), F.col("part")).alias("name"), "content"), folder).count()
    parts = F.expr(f"case when n > {tiles.FILE_POINTS} then sequence(1, cast((n - 1) div {tiles.FILE_POINTS} as int)) else cast(array() as array<int>) end")
    # Boxes and numbers of the tiles as they are now, from those of before: no point is read again.
    ends = [F.min(k).alias(k) if k[1] == "0" else F.max(k).alias(k) for k in index.BOX]
    stats = counts.join(targets, "path").groupBy("target").agg(F.sum("n").alias("n"), *ends).withColumnRenamed("target", "path")
    total = stats.agg(F.sum("n")).first()[0] or 0
    stats = stats.where("path <> ''").withColumn("uri", index.tile_file())
    stats = stats.withColumn("more", F.transform(parts, lambda k: tiles.part_name(F.col("uri"), k)))
    below = tiles.fold_tiles(stats, meta["spacing"], meta["scale"], folder).collect()  # at most 8^5 rows
    given = {r["path"]: (json.loads(r["node"]), r["size"], list(r["box"])) for r in below}
    rows = [r.asDict() for r in stats.where(F.length("path") <= tiles.FOLD_AT).collect()]  # and at most 8^4
    rows.append({"path": "", "uri": None, "more": [f"r_{k}.pnts" for k in range(1, heads)], **index.bounds(top).first().asDict()})
    files = tiles.tileset_json(rows, meta["spacing"], meta["scale"], linalg.column_major(meta["transform"]), "r.pnts", given)
    for name, text in files.items():
        tiles.write_text(f"{folder}/{name}", text)
    return {"points": total, "tiles": written.count() + heads}


def convert(spark: SparkSession, files: list[str], folder: str, options: Options | None = None) -> dict:
    return convert_points(read_points(spark, files), folder, options)


def guard(folder: str, overwrite: bool) -> None:
    """Empty the folder, or refuse if there is something in it."""
    system, path = las.open_uri(folder)
    if system.get_file_info(path).type.name == "Directory":
        if not overwrite:
            raise FileExistsError(folder)
        system.delete_dir_contents(path)
