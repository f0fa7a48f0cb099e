"""Several tilesets under one quadtree."""

from __future__ import annotations

import json
import posixpath
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith.functions import codec, index, linalg
from voxelith.sources import las, tiles

#: Points of an overview at most, and the share of each tileset's root tile at most.
OVERVIEW_POINTS, OVERVIEW_SHARE = 50000, 0.5
LEAST_DIAGONAL = 1.0


def box_corners(volume: list[float]) -> np.ndarray:
    """The eight corners of a tileset's box."""
    c, axes = np.array(volume[:3]), np.array(volume[3:12]).reshape(3, 3)
    signs = np.array([[i & 1, i >> 1 & 1, i >> 2 & 1] for i in range(8)]) * 2 - 1
    return c + signs @ axes


def to_box(corners: np.ndarray) -> list[float]:
    return [*corners.min(axis=0).tolist(), *corners.max(axis=0).tolist()]


def describe(uri: str, text: str) -> dict:
    """A tileset's transform, world box, error and root content."""
    doc = json.loads(text)
    root = doc["root"]
    matrix = np.array(root.get("transform") or np.eye(4).ravel().tolist()).reshape(4, 4).T
    corners = np.c_[box_corners(root["boundingVolume"]["box"]), np.ones(8)] @ matrix.T
    content = root.get("content") or {}
    return {
        "uri": uri,
        "transform": linalg.column_major(matrix),
        **dict(zip(index.BOX, to_box(corners[:, :3]), strict=True)),
        "error": float(doc.get("geometricError", root.get("geometricError", 0.0))),
        "content": content.get("uri") or content.get("url"),
    }


def quadrant_paths(sets: DataFrame, levels: int) -> DataFrame:
    """tilesets(id, x0..z1) with the path of forced quadrants that holds their centre.  Boxes are
    half open, so a centre on a border has one path."""
    centre = sets.select("id", *[F.expr(f"({c}0 + {c}1) / 2D").alias(c) for c in "xyz"])
    root = sets.agg(*[F.min(f"{c}0").alias(f"{c}0") for c in "xyz"], *[F.max(f"{c}1").alias(f"{c}1") for c in "xyz"])
    df = centre.crossJoin(F.broadcast(root)).withColumn("path", F.lit(""))  # the root is one row
    for _ in range(levels):
        keep = ["id", "x", "y", "z"]
        df = df.withColumn("flat", F.lit(True))
        df = df.select(*keep, *index.BOX, "path", "flat", index.child_digit().alias("digit"))
        df = df.select(*keep, *index.child_box(), F.concat("path", F.col("digit").cast("string")).alias("path"))
    return df


def quadtree(sets: DataFrame, most: int = 12) -> DataFrame:
    """(id, path): each tileset at the first level where it is alone, or at `most`."""
    deep = quadrant_paths(sets, most).select("id", F.col("path").alias("full"))
    each = deep.select("id", "full", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("depth")).withColumn("path", F.expr("substring(full, 1, depth)"))
    alone = each.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.min(F.struct(F.length("path").alias("d"), "path")).alias("s"))
    return deep.join(alone, "id", "left").select("id", F.coalesce(F.col("s.path"), F.col("full")).alias("path"))


def overview(points: DataFrame, path: str = "path", by: str = "id", most: int = OVERVIEW_POINTS) -> DataFrame:
    """Of the points of each quadrant an even share of each tileset's root tile, at most `most` and
    half; chosen by a hash, without replacement, so the same ones each time."""
    n = points.groupBy(path, by).agg(F.count("*").alias("_n"))
    total = n.groupBy(path).agg(F.sum("_n").alias("_total"))
    take = n.join(total, path).select(path, by, "_n", F.expr(f"cast(floor(_n * least({OVERVIEW_SHARE}D, {float(most)}D / _total)) as bigint)").alias("_take"))
    # Hashes are spread evenly, so the least `_take` lie below their share and seven deviations; only
    # what is below is sorted.
    some = points.withColumn("_hash", F.xxhash64("x", "y", "z")).join(take, [path, by])
    some = some.where("_hash / 18446744073709551616D + 0.5D <= (_take + 7 * sqrt(_take) + 50) / _n")
    rank = F.row_number().over(Window.partitionBy(path, by).orderBy("_hash", "x", "y", "z"))
    return some.withColumn("_rank", rank).where("_rank <= _take").drop("_rank", "_take", "_n", "_hash")


def levels(box: dict[str, float], most: int = 12) -> int:
    """Divisions of a box until a quadrant's diagonal, seen from above, is under LEAST_DIAGONAL."""
    wide = float(np.hypot(box["x1"] - box["x0"], box["y1"] - box["y0"]))
    return min(most, max(0, int(np.floor(np.log2(wide / LEAST_DIAGONAL))) + 1) if wide > 0 else 0)


def root_points(spark: SparkSession, sets: list[dict], paths: dict[int, str], inverse: np.ndarray) -> DataFrame:
    """(id, path, x, y, z, r, g, b): the points of all inputs' root tiles in the first one's frame, once
    for each inner quadrant above the input.  One reading, joined with a row an input."""
    rows = []
    for s in sets:
        if s["content"]:
            m = inverse @ np.array(s["transform"]).reshape(4, 4).T
            inner = [paths[s["id"]][:i] for i in range(len(paths[s["id"]]))] or [""]
            rows.append((posixpath.join(posixpath.dirname(s["uri"]), s["content"]), s["id"], inner, m[:3].ravel().tolist()))
    if not rows:
        return None
    meta = spark.createDataFrame([(_bare(u), *rest) for u, *rest in rows], "_uri string, id long, _paths array<string>, _m array<double>")
    own = tiles.tile_points(tiles.read_tiles(spark, [r[0] for r in rows])).withColumn("_uri", F.regexp_replace("uri", "^[A-Za-z0-9]+:/*", "/"))
    m = F.col("_m")
    moved = {c: m[4 * i] * F.col("x") + m[4 * i + 1] * F.col("y") + m[4 * i + 2] * F.col("z") + m[4 * i + 3] for i, c in enumerate("xyz")}
    return own.join(meta, "_uri").withColumns(moved).withColumn("path", F.explode("_paths")).drop("_uri", "_paths", "_m")


def _bare(uri: str) -> str:
    return re.sub("^[A-Za-z0-9]+:/*", "/", uri)


def merge(spark: SparkSession, folder: str, overwrite: bool = False) -> dict[str, int]:
    """Write folder/tileset.json over the tilesets below folder, and an overview for each inner
    quadrant.  The driver holds a row an input, which the merged JSON names one by one anyway."""
    found = [r for r in tiles.read_tilesets(spark, folder).collect() if posixpath.dirname(r["uri"]) != posixpath.dirname(f"file://{las.open_uri(folder)[1]}/x")]
    sets = [{"id": i, **describe(r["uri"], r["json"])} for i, r in enumerate(sorted(found, key=lambda r: r["uri"]))]
    system, base = las.open_uri(folder)
    old = system.get_file_info(f"{base}/tileset.json").type.name == "File"
    if old and not overwrite:
        raise FileExistsError(f"{folder}/tileset.json")
    if not sets:
        return {"tilesets": 0, "tiles": 0}
    frame = spark.createDataFrame([(s["id"], *[s[k] for k in index.BOX]) for s in sets], "id long, " + ", ".join(f"{k} double" for k in index.BOX))
    whole = {k: (min if k[1] == "0" else max)(s[k] for s in sets) for k in index.BOX}
    paths = {r["id"]: r["path"] for r in quadtree(frame, levels(whole)).collect()}
    first = np.array(sets[0]["transform"]).reshape(4, 4).T
    every = root_points(spark, sets, paths, linalg.inverse_matrix(first))
    made = 0
    if every is not None:
        content = tiles.encode_tiles(overview(every), ("id", "x", "y", "z"), True).where("n > 0")
        made = tiles.write_files(content.select(F.concat(F.lit("r"), "path", F.lit(".pnts")).alias("name"), "content"), folder).count()
    doc = assemble(sets, paths, first, folder, every is not None)
    tiles.write_text(f"{folder}/tileset.json", json.dumps(doc))
    return {"tilesets": len(sets), "tiles": made}


def assemble(sets: list[dict], paths: dict[int, str], first: np.ndarray, folder: str, content: bool) -> dict:
    """The merged tileset: inner quadrants with their overview, leaves that refer to the inputs."""
    inverse = linalg.inverse_matrix(first)
    root_uri = las.open_uri(folder)[1]

    def box(members: list[dict]) -> list[float]:
        corners = np.concatenate([np.c_[np.array([[s[f"x{i & 1}"], s[f"y{i >> 1 & 1}"], s[f"z{i >> 2}"]] for i in range(8)]), np.ones(8)] @ inverse.T for s in members])
        low, high = corners[:, :3].min(axis=0), corners[:, :3].max(axis=0)
        half = np.diag((high - low) / 2)
        return [*((low + high) / 2).tolist(), *half.ravel().tolist()]

    def leaf(s: dict) -> dict:
        """The input has its own transform, so the root's is undone and the box is the world's."""
        uri = posixpath.relpath(s["uri"].split("://")[-1].removeprefix("file:"), root_uri)
        low, high = (np.array([s[f"{c}{i}"] for c in "xyz"]) for i in (0, 1))
        volume = [*((low + high) / 2).tolist(), *np.diag((high - low) / 2).ravel().tolist()]
        return {"transform": linalg.column_major(inverse), "geometricError": s["error"], "boundingVolume": {"box": volume}, "content": {"uri": uri}}

    def node(path: str, members: list[dict]) -> dict:
        here = [s for s in members if paths[s["id"]] == path]
        below = sorted({paths[s["id"]][: len(path) + 1] for s in members if paths[s["id"]] != path})
        if len(members) == 1 and path:
            return leaf(members[0])
        out = {"children": [leaf(s) for s in here] + [node(p, [s for s in members if paths[s["id"]].startswith(p)]) for p in below]}
        out |= {"geometricError": sum(s["error"] for s in members), "boundingVolume": {"box": box(members)}, "refine": "ADD"}
        if content:
            out["content"] = {"uri": f"r{path}.pnts"}
        return out

    root = node("", sets)
    root |= {"transform": linalg.column_major(first), "refine": "REPLACE"}
    span = np.array(root["boundingVolume"]["box"][3:]).reshape(3, 3)
    return {"asset": {"version": "1.0"}, "geometricError": float(2 * np.linalg.norm(np.diag(span))), "root": root}


def remove(folder: str) -> int:
    """Delete a merged tileset and the overviews it refers to; inputs stay.  Content of a kind other
    than pnts and json is refused."""
    system, base = las.open_uri(folder)
    with system.open_input_file(f"{base}/tileset.json") as f:
        doc = json.loads(f.read())
    names, todo = [], [doc["root"]]
    while todo:
        n = todo.pop()
        todo += n.get("children", [])
        uri = (n.get("content") or {}).get("uri")
        if uri and uri.endswith(".pnts"):
            names.append(uri)
        elif uri and not uri.endswith(".json"):
            raise codec.TileError(f"content of an unknown kind: {uri}")
    for n in names:
        system.delete_file(f"{base}/{n}")
    system.delete_file(f"{base}/tileset.json")
    return len(names)
