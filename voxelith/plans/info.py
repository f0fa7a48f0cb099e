"""What tiles hold."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxelith.functions import codec
from voxelith.sources import tiles


def info(spark: SparkSession, path: str) -> DataFrame:
    """The header words of tile files."""
    return tiles.read_tiles(spark, path).drop("content")


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(uri, text): each tile file described, where it is read; texts are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [describe(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["uri", "text"])

    return tiles.read_tiles(spark, path).select("uri", "content").mapInArrow(run, "uri string, text string")


def describe(content: bytes) -> str:
    """A tile as text: header, feature table and first point, or glTF header."""
    h = codec.header(content)
    lines = ["Tile header", "-" * 11, f"Magic value: {h['magic'].decode()}", f"Version: {h['version']}", f"Tile byte length: {h['total']}"]
    lines += [f"Feature table json byte length: {h['ft_json']}", f"Feature table bin byte length: {h['ft_bin']}"]
    lines += [f"Batch table json byte length: {h['bt_json']}", f"Batch table bin byte length: {h['bt_bin']}"]
    if h["magic"] == b"pnts":
        points, batch = codec.decode_pnts(content)
        lines += ["", "Feature table", "-" * 13, f"Points: {len(points)}", f"Colors: {points.rgb is not None}", f"Center: {points.rtc}"]
        if len(points):
            lines += ["", "First point", "-" * 11, json.dumps(points.feature(0))]
        if batch:
            lines += ["", json.dumps(batch)]
    else:
        head, _, batch, _ = codec.decode_b3dm(content)
        lines += ["", "glTF header", "-" * 11, json.dumps(head)] + ([json.dumps(batch)] if batch else [])
    return "\n".join(lines)


def to_hex(content: bytes) -> str:
    """Upper-case pairs of digits, separated by spaces."""
    return " ".join(f"{b:02X}" for b in content)
