"""Polygon features: folders of WKB files, database tables, and their triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import mesh


def read_wkb(spark: SparkSession, path: str) -> DataFrame:
    """features(fid, name, wkb) of the .wkb files in a folder; fid is a hash of the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wkb").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("wkb"))
    return named.select(F.xxhash64("name").alias("fid"), "name", "wkb")


def read_database(spark: SparkSession, url: str, table: str, column: str, id_column: str | None = None, **options: str) -> DataFrame:
    """features(fid, wkb) of a PostGIS table; geometry is fetched as WKB, all else is done here.

    Without an id column fid is a hash of the geometry, which every reading gives alike.  Options of
    Spark's JDBC source that divide the reading (partitionColumn fid, bounds, numPartitions) pass on."""
    key = f"{id_column} as fid, " if id_column else ""
    got = spark.read.format("jdbc").options(url=url, dbtable=f"(select {key}ST_AsBinary({column}) as wkb from {table}) as features", **options).load()
    return got.select(F.col("fid").cast("long").alias("fid") if id_column else F.xxhash64("wkb").alias("fid"), "wkb")


_CORNERS = [f"{v}{c}" for v in "abc" for c in "xyz"]
_TEXTURE = [f"{v}{c}" for v in "abc" for c in "uv"]


def triangles(features: DataFrame) -> DataFrame:
    """(fid, tri, ax..cz, nx, ny, nz): the triangles of features(fid, wkb), faces outward.  A null wkb
    has none.  Features are dealt to all shuffle partitions first, as a small file can hold much work.

    If features has a column `uv`, WKB of polygons whose points are the texture places of the points in
    `wkb`, one by one, the texture places of the triangles' corners follow (au..cv; 0 where uv is null)."""
    textured = "uv" in features.columns
    names = ["fid", "tri", *_CORNERS, "nx", "ny", "nz", *(_TEXTURE if textured else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, parts, places = [], [], [], []
            for k, (fid, wkb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if wkb.is_valid:
                    polygons = mesh.read_wkb(wkb.as_py())
                    if not textured:
                        own = [mesh.triangulate(p)[0] for p in polygons if len(p) and len(p[0]) > 2]
                        ids.append(fid)
                        counts.append(sum(len(t) for t in own))
                        parts += own
                        continue
                    uv = mesh.read_wkb(batch.column(2)[k].as_py()) if batch.column(2)[k].is_valid else [[0 * r for r in p] for p in polygons]
                    if [[len(r) for r in p] for p in uv] != [[len(r) for r in p] for p in polygons]:
                        raise ValueError(f"feature {fid}: texture places are not one for each point")
                    own = [mesh.triangulate(p, [q]) for p, q in zip(polygons, uv, strict=True) if len(p) and len(p[0]) > 2]
                    ids.append(fid)
                    counts.append(sum(len(t) for t, _ in own))
                    parts += [t for t, _ in own]
                    places += [t[:, :, :2] for _, t in own]
            if not sum(counts):
                continue
            tri = np.concatenate([p for p in parts if len(p)])
            each = [np.repeat(np.array(ids, np.int64), counts), np.concatenate([np.arange(n) for n in counts])]
            flat, n = tri.reshape(-1, 9), mesh.normals(tri)[::3]
            cols = [*each, *(flat[:, i] for i in range(9)), *(n[:, i] for i in range(3))]
            if textured:
                at = np.concatenate([p for p in places if len(p)]).reshape(-1, 6)
                cols += [at[:, i] for i in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    schema = "fid long, tri long, " + ", ".join(f"{c} double" for c in names[2:])
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return features.select(F.col("fid").cast("long"), "wkb", *(["uv"] if textured else [])).repartition(parts).mapInArrow(run, schema)


def turned(tri: DataFrame, offset: list[float]) -> DataFrame:
    """Triangles with z up moved by -offset and turned to y up: (x, y, z) becomes (x, z, -y)."""
    x, y, z = offset
    out = {f"{v}x": F.col(f"{v}x") - x for v in "abc"}
    out |= {f"{v}y": F.col(f"{v}z") - z for v in "abc"} | {f"{v}z": -(F.col(f"{v}y") - y) for v in "abc"}
    return tri.withColumns(out | {"ny": F.col("nz"), "nz": -F.col("ny")})


def boxes(tri: DataFrame, up: str = "z") -> DataFrame:
    """(fid, box, weight): each feature's box and its area seen from above."""
    u, v = ("x", "y") if up == "z" else ("x", "z")
    low = [F.min(F.least(*[f"{v}{c}" for v in "abc"])).alias(f"{c}0") for c in "xyz"]
    high = [F.max(F.greatest(*[f"{v}{c}" for v in "abc"])).alias(f"{c}1") for c in "xyz"]
    area = F.expr(f"abs((b{u} - a{u}) * (c{v} - a{v}) - (b{v} - a{v}) * (c{u} - a{u})) / 2D")
    return tri.groupBy("fid").agg(*low, *high, F.sum(area).alias("weight"))
