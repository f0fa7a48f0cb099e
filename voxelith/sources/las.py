"""LAS point clouds: a data source `voxelith_las` that plans ranges of records from the headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelith.functions import color

SCHEMA = "src string, seq long, ix int, iy int, iz int, intensity int, red int, green int, blue int"
#: Records in a partition at most.
PORTION = 1_000_000
#: Fixed values of the format: byte offset of red, green and blue in a record, by point format.
_COLOR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def list_files(uri: str, suffixes: tuple[str, ...], recursive: bool = False) -> list[str]:
    """The files at uri: itself, or those in the folder with one of the suffixes, sorted."""
    system, path = open_uri(uri)
    scheme = uri.split("://")[0] + "://" if "://" in uri else "file://"
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    found = system.get_file_info(fs.FileSelector(path, recursive=recursive))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes))


@dataclass(frozen=True)
class Header:
    count: int
    start: int
    size: int
    format: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def colored(self) -> bool:
        return self.format in _COLOR_AT


def parse_header(raw: bytes) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = raw[25]
    (start,) = struct.unpack_from("<I", raw, 96)
    kind, size, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed records (LAZ) are not supported")
    v = struct.unpack_from("<12d", raw, 131)
    if minor >= 4:
        (long_count,) = struct.unpack_from("<Q", raw, 247)
        count = long_count or count
    return Header(count, start, size, kind, v[0:3], v[3:6], (v[7], v[9], v[11]), (v[6], v[8], v[10]))


def read_header(uri: str) -> Header:
    system, path = open_uri(uri)
    with system.open_input_file(path) as f:
        return parse_header(f.read_at(375, 0))


class Portion(InputPartition):
    def __init__(self, uri: str, head: Header, first: int, count: int):
        self.uri, self.head, self.first, self.count = uri, head, first, count


class LasReader(DataSourceReader):
    def __init__(self, uris: list[str], portion: int):
        self.uris, self.portion = uris, portion

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri in self.uris:
            head = read_header(uri)
            out += [Portion(uri, head, i, min(self.portion, head.count - i)) for i in range(0, head.count, self.portion)]
        return out or [Portion("", None, 0, 0)]

    def read(self, part: Portion) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        h = part.head
        fields = [("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("intensity", "<u2")]
        at = [0, 4, 8, 12]
        if h.colored:
            c = _COLOR_AT[h.format]
            fields += [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
            at += [c, c + 2, c + 4]
        kind = np.dtype({"names": [n for n, _ in fields], "formats": [f for _, f in fields], "offsets": at, "itemsize": h.size})
        system, path = open_uri(part.uri)
        with system.open_input_file(path) as f:
            for i in range(0, part.count, 65536):
                n = min(65536, part.count - i)
                rec = np.frombuffer(f.read_at(n * h.size, h.start + (part.first + i) * h.size), kind, n)
                cols = [pa.array([part.uri] * n), pa.array(np.arange(part.first + i, part.first + i + n))]
                cols += [pa.array(rec[c].astype(np.int32)) for c in ("ix", "iy", "iz", "intensity")]
                cols += [pa.array(rec[c].astype(np.int32)) if h.colored else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxelith_las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(list_files(self.options["path"], (".las",)), int(self.options.get("portion", PORTION)))


#: Points at a file's start whose red tells how many bits colours have.
PROBED = 10_000


def highest_red(uri: str, head: Header) -> int:
    """Of the first points; 0 where there is no colour."""
    n = min(PROBED, head.count)
    if not head.colored or not n:
        return 0
    system, path = open_uri(uri)
    with system.open_input_file(path) as f:
        raw = f.read_at(n * head.size, head.start)
    kind = np.dtype({"names": ["red"], "formats": ["<u2"], "offsets": [_COLOR_AT[head.format]], "itemsize": head.size})
    return int(np.frombuffer(raw, kind, n)["red"].max())


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(src, n, scale and offset per axis, box, colored, high) of each file, from its header and, for
    high, the red of its first points."""
    rows = []
    for uri in list_files(path, (".las",)):
        h = read_header(uri)
        rows.append((uri, h.count, *map(float, (*h.scale, *h.offset, *h.low, *h.high)), h.colored, highest_red(uri, h)))
    names = [f"{a}{c}" for a in ("s", "o", "low", "high") for c in "xyz"]
    return spark.createDataFrame(rows, "src string, n long, " + ", ".join(f"{n} double" for n in names) + ", colored boolean, high int")


def read_las(spark: SparkSession, path: str, portion: int = PORTION) -> DataFrame:
    """points(src, seq, x, y, z, r, g, b): dequantised by the header, colours as 0 to 255, the
    intensity where there are none."""
    spark.dataSource.register(LasSource)
    raw = spark.read.format("voxelith_las").option("path", path).option("portion", portion).load()
    out = raw.join(metadata(spark, path).drop("n", "colored"), "src")  # a row a file, from the same listing
    scale = F.when(F.col("red").isNull(), F.lit(1 / 257)).otherwise(color.sixteen_bit_scale(F.col("high")))
    colors = [F.floor(F.coalesce(F.col(c), F.col("intensity")) * scale).cast("int").alias(c[0]) for c in ("red", "green", "blue")]
    return out.select("src", "seq", *[(F.col(f"i{c}") * F.col(f"s{c}") + F.col(f"o{c}")).alias(c) for c in "xyz"], *colors)


def write_las(path: str, xyz: np.ndarray, rgb: np.ndarray | None = None, intensity: np.ndarray | None = None, scale: float = 0.001) -> None:
    """A small LAS 1.2 file, for exchange and tests."""
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    low = xyz.min(axis=0) if len(xyz) else np.zeros(3)
    high = xyz.max(axis=0) if len(xyz) else np.zeros(3)
    kind = 2 if rgb is not None else 0
    size = 26 if kind else 20
    rec = np.zeros(len(xyz), np.dtype({"names": ["p", "i", "c"], "formats": ["3<i4", "<u2", "3<u2"], "offsets": [0, 12, 20 if kind else 13], "itemsize": size if kind else 20}))
    rec["p"] = np.round((xyz - low) / scale).astype(np.int32)
    if intensity is not None:
        rec["i"] = intensity
    if kind:
        rec["c"] = rgb
    head = bytearray(227)
    head[0:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, kind, size, len(xyz))
    struct.pack_into("<12d", head, 131, scale, scale, scale, *low, *[v for a, b in zip(high, low, strict=True) for v in (a, b)])
    system, local = open_uri(path)
    with system.open_output_stream(local) as f:
        f.write(bytes(head) + rec.tobytes())
