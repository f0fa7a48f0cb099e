"""Polygon features to batched tiles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import codec, index, linalg
from voxelith.operators import features as ops
from voxelith.operators.lod import starts
from voxelith.operators.tables import materialize
from voxelith.sources import tiles, wkb

ROOT_ERROR = 500.0
#: Files are passed on when so many bytes of them are ready.
FILES_BYTES = 4 << 20


def encode_nodes(tri: DataFrame, assigned: DataFrame, texture: str | None = None) -> DataFrame:
    """(name, content): a b3dm file for each node, a batch for each feature; with the address of a
    texture, the triangles' texture places go into the file.

    Rows are sorted by node; a task holds one node's triangles, and a node keeps a bounded number of
    features."""
    if texture and "au" not in tri.columns:
        raise ValueError("a texture needs triangles with texture places")

    corners = [f"{v}{c}" for v in "abc" for c in "xyz"]
    cols = ["node", "fid", "tri", *corners, "nx", "ny", "nz", *([f"{v}{c}" for v in "abc" for c in "uv"] if texture else [])]

    def build(parts: list[pa.RecordBatch]) -> bytes:
        get = lambda c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
        fid = get("fid")
        by = np.lexsort((get("tri"), fid))
        flat = np.column_stack([get(c) for c in cols[3:]])[by]
        ids, at = np.unique(fid, return_inverse=True)
        uvs = flat[:, 12:].reshape(-1, 2) if texture else None
        one = codec.Mesh(flat[:, :9].reshape(-1, 3), np.repeat(flat[:, 9:12], 3, axis=0), uvs, np.repeat(at[by], 3))
        return codec.encode_b3dm(codec.encode_glb([one], texture=texture), {"id": ids.tolist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"tiles/{n}.b3dm" for n, _ in done], pa.string()), pa.array([d for _, d in done], pa.binary())], names=["name", "content"])

        node, parts, done, held = None, [], [], 0
        for batch in batches:
            cuts = starts(batch, 1) if batch.num_rows else []
            for at, end in zip(cuts, cuts[1:], strict=False):
                now = batch.column(0)[at].as_py()
                if parts and now != node:
                    done.append((node, build(parts)))
                    parts, held = [], held + len(done[-1][1])
                node = now
                parts.append(batch.slice(at, end - at))
            if held > FILES_BYTES:
                yield out(done)
                done, held = [], 0
        if parts:
            done.append((node, build(parts)))
        yield out(done)

    both = tri.join(assigned.select("fid", "node"), "fid").select(*cols)
    return both.repartition("node").sortWithinPartitions("node").mapInArrow(run, "name string, content binary")


def tileset(nodes: list[dict], filled: set[str], transform: list[float]) -> dict:
    """The tileset of nodes(node, box): root cells and their quarters, the error halved per level."""
    boxes = {n["node"]: [n[k] for k in index.BOX] for n in nodes}

    def cell(n: str) -> str:
        return "_".join(n.split("_")[:2])

    def below(n: str) -> list[str]:
        return sorted(m for m in boxes if m != n and cell(m) == cell(n) and (m.startswith(n) and len(m) == len(n) + 1 if n.count("_") == 2 else m.count("_") == 2 and len(m) == len(n) + 2))

    def node(box: list[float], error: float, children: list[dict], name: str | None) -> dict:
        volume = [*[(box[i] + box[i + 3]) / 2 for i in range(3)], *[(box[i + 3] - box[i]) / 2 if i == k else 0 for i in range(3) for k in range(3)]]
        out = {"boundingVolume": {"box": [round(v, 3) for v in volume]}, "geometricError": error, "children": children, "refine": "ADD"}
        return out | ({"content": {"uri": f"tiles/{name}.b3dm"}} if name in filled else {})

    def walk(n: str, error: float) -> dict:
        return node(boxes[n], error, [walk(c, error / 2) for c in below(n)], n)

    tops = sorted(n for n in boxes if n.count("_") == 1)
    whole = [min(b[i] for b in boxes.values()) if i < 3 else max(b[i] for b in boxes.values()) for i in range(6)] if boxes else [0.0] * 6
    root = node(whole, ROOT_ERROR, [walk(n, ROOT_ERROR / 2) for n in tops], None)
    return {"asset": {"version": "1.0"}, "geometricError": ROOT_ERROR, "root": root | {"transform": [round(float(v), 3) for v in transform]}}


def export_triangles(tri: DataFrame, folder: str, transform: list[float], texture: str | None = None) -> dict[str, int]:
    """Write triangles with y up, as models have it, as a tileset of b3dm files in folder.  Boxes are
    given with z up, as tilesets have it; the larger features of a cell come first."""
    placed = materialize(ops.assign(ops.swap_up(wkb.boxes(tri, "y"))), "assigned")
    written = tiles.write_files(encode_nodes(tri, placed, texture), folder).count()
    nodes = [r.asDict() for r in ops.node_boxes(placed).collect()]  # a row a node
    filled = {r["node"] for r in placed.select("node").distinct().collect()}
    tiles.write_text(f"{folder}/tileset.json", json.dumps(tileset(nodes, filled, transform)))
    return {"features": placed.count(), "tiles": written}


def export_features(features: DataFrame, folder: str, transform: list[float] | None = None, texture: str | None = None) -> dict[str, int]:
    """Write features(fid, wkb), whose y axis points up, as a tileset; a texture needs a column uv."""
    return export_triangles(materialize(wkb.triangles(features), "triangles"), folder, transform or linalg.column_major(np.eye(4)), texture)


def export_z_up(features: DataFrame, folder: str) -> dict[str, int]:
    """Write features(fid, wkb), whose z axis points up: moved to their centre, which the tileset's
    transform undoes, and turned to y up, which viewers undo."""
    tri = materialize(wkb.triangles(features), "triangles")
    box = wkb.boxes(tri).agg(*[((F.min(f"{c}0") + F.max(f"{c}1")) / 2).alias(c) for c in "xyz"]).first()
    offset = [box[c] or 0.0 for c in "xyz"]
    return export_triangles(materialize(wkb.turned(tri, offset), "turned"), folder, linalg.column_major(linalg.translation_matrix(offset)))


def export_directory(spark: SparkSession, source: str, folder: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict[str, int]:
    """Write the WKB files of a folder, placed by offset."""
    return export_features(wkb.read_wkb(spark, source), folder, linalg.column_major(linalg.translation_matrix(offset)))


def export_database(spark: SparkSession, url: str, table: str, column: str, folder: str, id_column: str | None = None, **options: str) -> dict[str, int]:
    """Write a database's features."""
    return export_z_up(wkb.read_database(spark, url, table, column, id_column, **options), folder)
