"""Tiles and tilesets as tables, and their sinks."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import codec, index
from voxelith.sources.las import open_uri


def read_tiles(spark: SparkSession, path: str | list[str], pattern: str = "*.{pnts,b3dm}") -> DataFrame:
    """(uri, magic, version, total, ft_json, ft_bin, bt_json, bt_bin, content) of tile files; files
    of another kind have a null kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    kind = F.when(F.col("magic") == "pnts", "POINTCLOUD").when(F.col("magic") == "b3dm", "BATCHED3DMODEL")
    return files.select(F.col("path").alias("uri"), "content").select("uri", *codec.header_columns(), "content").withColumn("kind", kind)


def tile_points(tiles: DataFrame) -> DataFrame:
    """(uri, seq, x, y, z, r, g, b) of the point tiles in tiles(uri, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points, _ = codec.decode_pnts(content.as_py())
                n = len(points)
                xyz = points.xyz.astype(np.float64) + np.array(points.rtc or [0.0] * 3)
                rgb = [pa.array(points.rgb[:, i].astype(np.int32)) if points.rgb is not None else pa.nulls(n, pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(np.arange(n)), *[pa.array(xyz[:, i]) for i in range(3)], *rgb], names=["uri", "seq", "x", "y", "z", "r", "g", "b"])

    found = tiles.where("decode(substring(content, 1, 4), 'UTF-8') = 'pnts'").select("uri", "content")
    return found.mapInArrow(run, "uri string, seq long, x double, y double, z double, r int, g int, b int")


#: Points of a file at most: a tile of more, such as one of points in one place, has several files.
FILE_POINTS = 1_000_000


def encode_tiles(points: DataFrame, order: tuple[str, ...] = ("x", "y", "z"), rgb: bool = False, by: str = "path", most: int = FILE_POINTS) -> DataFrame:
    """(path, part, n, content): a pnts file for each `most` points of a path, in `order`.

    Paths are hashed to partitions and sorted; a task streams through them and holds one file."""
    cols = list(dict.fromkeys([by, *order, "x", "y", "z", *("rgb" if rgb else "")]))
    dealt = points.select(*cols).repartition(by).sortWithinPartitions(by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, part, held, xyz, colors = None, 0, 0, [], []

        def tile() -> pa.RecordBatch:
            p = np.concatenate(xyz)
            c = np.concatenate(colors) if rgb else None
            data = codec.encode_pnts(codec.Points(p.astype("<f4"), c))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([len(p)], pa.int64()), pa.array([data], pa.binary())], names=[by, "part", "n", "content"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            own = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"])
            tint = np.column_stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in "rgb"]).astype(np.uint8) if rgb else None
            at = 0
            while at < len(keys):
                same = keys[at] == path
                if xyz and (not same or held == most):
                    yield tile()
                    xyz, colors, held = [], [], 0
                    part = part + 1 if same else 0
                elif not same:
                    part = 0
                path, end = keys[at], at + 1
                while end < min(len(keys), at + most - held) and keys[end] == path:
                    end += 1
                xyz.append(own[at:end])
                if rgb:
                    colors.append(tint[at:end])
                held, at = held + end - at, end
        if xyz:
            yield tile()

    return dealt.mapInArrow(run, f"{by} string, part int, n long, content binary")


def part_name(name: F.Column, part: F.Column) -> F.Column:
    """The file of a tile's part: that of the first has the tile's name."""
    return F.when(part == 0, name).otherwise(F.regexp_replace(name, r"[.]pnts$", F.concat(F.lit("_"), part.cast("string"), F.lit(".pnts"))))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write files(name, content) under folder; gives (name, bytes) of what was written.

    A name is written whole under another name first and then moved, so a repeated attempt
    replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = open_uri(folder)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = posixpath.join(root, name)
                system.create_dir(posixpath.dirname(target), recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.part"
                data = content.as_buffer()
                with system.open_output_stream(draft, compression=None) as f:
                    f.write(data)
                system.move(draft, target)
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long")


def write_text(uri: str, text: str) -> None:
    system, path = open_uri(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(text.encode())


#: A subtree whose JSON is longer becomes a file of its own.
EXTERNAL_CHARS = 100_000


def node_json(tile: dict, children: list[dict], spacing: float, scale: float) -> dict:
    """One tile of a tileset; the box is the tile's and its children's.  Files after a tile's first one
    (`more`) are children without children."""
    box = [tile[k] for k in index.BOX]
    out: dict = {
        "boundingVolume": {"box": [*[(box[i] + box[i + 3]) / 2 for i in range(3)], *[(box[i + 3] - box[i]) / 2 if i == k else 0.0 for i in range(3) for k in range(3)]]},
        "geometricError": 10 * spacing / 2 ** (len(tile["path"]) + 1) / scale,
        "refine": "ADD",
    }
    if tile.get("uri"):
        out["content"] = {"uri": tile["uri"]}
    more = [{k: out[k] for k in ("boundingVolume", "geometricError", "refine")} | {"content": {"uri": u}} for u in tile.get("more") or []]
    if children or more:
        out["children"] = more + children
    return out


def fold(tiles: list[dict], spacing: float, scale: float, above: int = 0, given: dict[str, tuple[dict, int, list[float]]] | None = None) -> tuple[dict[str, tuple[dict, int, list[float]]], dict[str, str]]:
    """Nodes of tiles (path, uri, box), nested: of each path of `above` digits (node, the length of its
    JSON, box), and the files of its own that a subtree of over EXTERNAL_CHARS characters becomes.

    Tiles that are missing between others are filled in without content.  given: finished nodes of
    longer paths."""
    given = given or {}
    known = {t["path"]: dict(t) for t in tiles}
    for path in [*known, *given]:
        for i in range(above, len(path)):
            known.setdefault(path[:i], {"path": path[:i], "uri": None, **{k: None for k in index.BOX}})
    kids: dict[str, list[str]] = {}
    for path in [*known, *given]:
        if len(path) > above:
            kids.setdefault(path[:-1], []).append(path)
    files: dict[str, str] = {}
    made = dict(given)
    for path in sorted(known, key=lambda p: (-len(p), p)):
        tile, children, total = known[path], [], 0
        boxes = [] if tile["x0"] is None else [[tile[k] for k in index.BOX]]
        for c in sorted(kids.get(path, [])):
            node, size, box = made.pop(c)
            boxes.append(box)
            if size > EXTERNAL_CHARS and node.get("children"):
                name = f"tileset.{c}.json"
                files[name] = json.dumps({"asset": {"version": "1.0"}, "geometricError": node["geometricError"], "root": node})
                node = {k: node[k] for k in ("boundingVolume", "geometricError", "refine")} | {"content": {"uri": name}}
                size = len(json.dumps(node))
            children.append(node)
            total += size + 2
        box = [(min if i < 3 else max)((b[i] for b in boxes), default=0.0) for i in range(6)]
        tile |= dict(zip(index.BOX, box, strict=True))
        made[path] = (node_json(tile, children, spacing, scale), len(json.dumps(node_json(tile, [], spacing, scale))) + total, box)
    return made, files


def tileset_json(tiles: list[dict], spacing: float, scale: float, transform: list[float], top: str | None = None, given: dict[str, tuple[dict, int, list[float]]] | None = None) -> dict[str, str]:
    """Files of a tileset by name, from its tiles' metadata (path, uri, box) and, below them, finished
    nodes.  Subtrees of over EXTERNAL_CHARS characters, but the root, are files of their own, which
    their parent refers to."""
    made, files = fold(tiles, spacing, scale, 0, given)
    root, _, box = made.get("", ({"boundingVolume": {"box": [0.0] * 12}, "geometricError": 0.0}, 0, [0.0] * 6))
    root |= {"transform": transform, "refine": "REPLACE"}
    if top:
        root["content"] = {"uri": top}
    error = float(np.sqrt(sum((box[i + 3] - box[i]) ** 2 for i in range(3)))) / scale
    files["tileset.json"] = json.dumps({"asset": {"version": "1.0"}, "geometricError": error, "root": root})
    return files


#: Digits of a path from which on tiles are folded where their rows are: the driver gets a node for each
#: of the at most 8^5 paths one digit longer, of up to EXTERNAL_CHARS characters.
FOLD_AT = 4


def fold_tiles(stats: DataFrame, spacing: float, scale: float, folder: str) -> DataFrame:
    """stats(path, uri, more, box) of tiles below FOLD_AT digits -> (path, node, size, box), a row for each
    path of FOLD_AT + 1 digits; subtrees that are files of their own are written to folder."""
    cols = ["path", "uri", "more", *index.BOX]
    deep = stats.where(F.length("path") > FOLD_AT).select(F.substring("path", 1, FOLD_AT + 1).alias("top"), *cols)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made, files = fold(table.select(cols).to_pylist(), spacing, scale, FOLD_AT + 1)
        for name, text in files.items():
            write_text(f"{folder}/{name}", text)
        (path, (node, size, box)), = made.items()
        if size > EXTERNAL_CHARS and node.get("children"):
            write_text(f"{folder}/tileset.{path}.json", json.dumps({"asset": {"version": "1.0"}, "geometricError": node["geometricError"], "root": node}))
            node = {k: node[k] for k in ("boundingVolume", "geometricError", "refine")} | {"content": {"uri": f"tileset.{path}.json"}}
            size = len(json.dumps(node))
        return pa.table({"path": [path], "node": [json.dumps(node)], "size": pa.array([size], pa.int64()), "box": pa.array([box], pa.list_(pa.float64()))})

    return deep.groupBy("top").applyInArrow(run, "path string, node string, size long, box array<double>")


def read_tilesets(spark: SparkSession, path: str) -> DataFrame:
    """(uri, json) of every tileset.json below path."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "tileset.json").text(path).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("json"))
