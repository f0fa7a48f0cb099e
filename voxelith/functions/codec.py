"""Tile content: pnts and b3dm files, feature and batch tables, binary glTF.

Bulk bodies are packed with numpy inside Arrow functions; headers can also be made and read as SQL
expressions, which need no Python."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = struct.Struct("<4s6I")
KINDS = {b"pnts": "POINTCLOUD", b"b3dm": "BATCHED3DMODEL"}
#: Fixed values of the glTF format.
GLTF_MAGIC, JSON_CHUNK, BIN_CHUNK = b"glTF", 0x4E4F534A, 0x004E4942
FLOAT, ARRAY_BUFFER = 5126, 34962


class TileError(ValueError):
    """A file is not a tile of a known kind, or its lengths disagree."""


def _padded(text: str, before: int) -> bytes:
    """With spaces up to the next multiple of four after `before` bytes, four if there already."""
    data = text.encode()
    return data + b" " * (4 - (len(data) + before) % 4)


def feature_table_json(n: int, rgb: bool = False, rgba: bool = False, rtc: list[float] | None = None, quantized: bool = False) -> bytes:
    """The feature table's header, padded."""
    head: dict = {"POINTS_LENGTH": n}
    if rtc is not None:
        head["RTC_CENTER"] = [float(v) for v in rtc]
    head["POSITION_QUANTIZED" if quantized else "POSITION"] = {"byteOffset": 0}
    if rgb or rgba:
        head["RGBA" if rgba else "RGB"] = {"byteOffset": n * (6 if quantized else 12)}
    return _padded(json.dumps(head, separators=(",", ":")), HEADER.size)


def batch_table_json(columns: dict[str, list]) -> bytes:
    return _padded(json.dumps(columns, separators=(",", ":")), 0)


@dataclass
class Points:
    """Positions (n, 3), float32 or quantized uint16, and colours (n, 3 or 4) or None."""

    xyz: np.ndarray
    rgb: np.ndarray | None = None
    rtc: list[float] | None = None

    def __len__(self) -> int:
        return len(self.xyz)

    def feature(self, i: int) -> dict:
        """Position and colour of one point."""
        out = {"positions": dict(zip("XYZ", self.xyz[i].tolist(), strict=True))}
        if self.rgb is not None:
            out["colors"] = dict(zip(("Red", "Green", "Blue", "Alpha"), self.rgb[i].tolist(), strict=False))
        return out

    @staticmethod
    def from_features(features: list[dict], rtc: list[float] | None = None, quantized: bool = False) -> Points:
        xyz = np.array([[f["positions"][c] for c in "XYZ"] for f in features], "<u2" if quantized else "<f4").reshape(-1, 3)
        colored = bool(features) and all(f.get("colors") for f in features)
        rgb = np.array([list(f["colors"].values()) for f in features], np.uint8) if colored else None
        return Points(xyz, rgb, rtc)


def encode_pnts(points: Points, batch: dict[str, list] | None = None) -> bytes:
    quantized = points.xyz.dtype.kind == "u"
    rgba = points.rgb is not None and points.rgb.shape[1] == 4
    head = feature_table_json(len(points), points.rgb is not None and not rgba, rgba, points.rtc, quantized)
    body = np.ascontiguousarray(points.xyz, "<u2" if quantized else "<f4").tobytes()
    if points.rgb is not None:
        body += np.ascontiguousarray(points.rgb, np.uint8).tobytes()
    table = batch_table_json(batch) if batch else b""
    total = HEADER.size + len(head) + len(body) + len(table)
    return HEADER.pack(b"pnts", 1, total, len(head), len(body), len(table), 0) + head + body + table


def header(data: bytes) -> dict:
    """The seven words of a tile."""
    if len(data) < HEADER.size:
        raise TileError("shorter than a header")
    names = ("magic", "version", "total", "ft_json", "ft_bin", "bt_json", "bt_bin")
    out = dict(zip(names, HEADER.unpack_from(data), strict=True))
    if out["magic"] not in KINDS:
        raise TileError(f"unknown kind {out['magic']!r}")
    if out["total"] != len(data):
        raise TileError(f"{len(data)} bytes, the header has {out['total']}")
    return out


def _parts(data: bytes) -> tuple[dict, dict, bytes, dict, bytes]:
    h = header(data)
    at, cut = HEADER.size, []
    for k in ("ft_json", "ft_bin", "bt_json", "bt_bin"):
        cut.append(data[at : at + h[k]])
        at += h[k]
    load = lambda b: json.loads(b) if b.strip() else {}
    return h, load(cut[0]), cut[1], load(cut[2]), data[at:]


def decode_pnts(data: bytes) -> tuple[Points, dict]:
    """Points and batch table."""
    h, ft, body, bt, _ = _parts(data)
    if h["magic"] != b"pnts":
        raise TileError("not a point cloud")
    n = ft["POINTS_LENGTH"]
    name, kind = ("POSITION", "<f4") if "POSITION" in ft else ("POSITION_QUANTIZED", "<u2")
    xyz = np.frombuffer(body, kind, 3 * n, ft[name]["byteOffset"]).reshape(n, 3)
    rgb = None
    for color, width in (("RGB", 3), ("RGBA", 4)):
        if color in ft:
            rgb = np.frombuffer(body, np.uint8, width * n, ft[color]["byteOffset"]).reshape(n, width)
    return Points(xyz, rgb, ft.get("RTC_CENTER")), bt


@dataclass
class Mesh:
    """One batch of triangles: vertices and normals (n, 3), texture coordinates (n, 2) or None."""

    positions: np.ndarray
    normals: np.ndarray
    uvs: np.ndarray | None = None
    #: The number of each vertex's batch, where a mesh holds several.
    batches: np.ndarray | None = None
    extra: dict = field(default_factory=dict)


def encode_glb(meshes: list[Mesh], batched: bool = True, transform: list[float] | None = None, texture: str | None = None) -> bytes:
    """Binary glTF 2 of meshes: all in one primitive with _BATCHID if batched, a mesh each if not."""
    if batched and meshes:
        ids = np.concatenate([np.full(len(m.positions), i, "<f4") if m.batches is None else m.batches.astype("<f4") for i, m in enumerate(meshes)])
        uv = np.concatenate([m.uvs for m in meshes]) if texture else None
        meshes = [Mesh(np.concatenate([m.positions for m in meshes]), np.concatenate([m.normals for m in meshes]), uv)]
    else:
        ids = None
    last = float(ids.max()) if ids is not None and len(ids) else 0.0
    columns: list[tuple[str, str, list[np.ndarray]]] = [
        ("POSITION", "VEC3", [np.ascontiguousarray(m.positions, "<f4") for m in meshes]),
        ("NORMAL", "VEC3", [np.ascontiguousarray(m.normals, "<f4") for m in meshes]),
    ]
    if texture:
        columns.append(("TEXCOORD_0", "VEC2", [np.ascontiguousarray(m.uvs, "<f4") for m in meshes]))
    if ids is not None:
        columns.append(("_BATCHID", "SCALAR", [ids]))
    views, accessors, attributes, body = [], [], [{} for _ in meshes], b""
    for name, kind, arrays in columns:
        start = len(body)
        for i, a in enumerate(arrays):
            flat = a.reshape(len(a), -1)
            low, high = {"NORMAL": ([-1.0] * 3, [1.0] * 3), "TEXCOORD_0": ([0.0] * 2, [1.0] * 2), "_BATCHID": ([0.0], [last])}.get(
                name, (flat.min(axis=0).tolist(), flat.max(axis=0).tolist()) if len(flat) else ([0.0] * 3, [0.0] * 3)
            )
            attributes[i][name] = len(accessors)
            accessors.append({"bufferView": len(views), "byteOffset": len(body) - start, "componentType": FLOAT, "count": len(a), "max": high, "min": low, "type": kind})
            body += a.tobytes()
        views.append({"buffer": 0, "byteLength": len(body) - start, "byteOffset": start, "target": ARRAY_BUFFER})
    matrix = [float(v) for v in transform] if transform is not None else np.eye(4).ravel().tolist()
    head: dict = {
        "asset": {"generator": "voxelith", "version": "2.0"},
        "scene": 0,
        "scenes": [{"nodes": list(range(len(meshes)))}],
        "nodes": [{"matrix": matrix, "mesh": i} for i in range(len(meshes))],
        "meshes": [{"primitives": [{"attributes": a, "material": 0, "mode": 4}]} for a in attributes],
        "materials": [{"pbrMetallicRoughness": {"metallicFactor": 0}, "name": "Material"}],
        "accessors": accessors,
        "bufferViews": views,
        "buffers": [{"byteLength": len(body)}],
    }
    if texture:
        head["textures"] = [{"sampler": 0, "source": 0}]
        head["images"] = [{"uri": texture}]
        head["samplers"] = [{"magFilter": 9729, "minFilter": 9987, "wrapS": 10497, "wrapT": 10497}]
        head["materials"][0]["pbrMetallicRoughness"]["baseColorTexture"] = {"index": 0}
    return pack_glb(head, body)


def pack_glb(head: dict, body: bytes) -> bytes:
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    total = 12 + 8 + len(text) + 8 + len(body)
    return struct.pack("<4s2I", GLTF_MAGIC, 2, total) + struct.pack("<2I", len(text), JSON_CHUNK) + text + struct.pack("<2I", len(body), BIN_CHUNK) + body


def decode_glb(data: bytes) -> tuple[dict, bytes]:
    """Header and body of a binary glTF, version 1 or 2."""
    magic, version, total = struct.unpack_from("<4s2I", data)
    if magic != GLTF_MAGIC or version not in (1, 2):
        raise TileError("not a binary glTF of version 1 or 2")
    if version == 1:
        size, kind = struct.unpack_from("<2I", data, 12)
        if kind != 0:
            raise TileError("unknown content format")
        return json.loads(data[20 : 20 + size]), data[20 + size : total]
    head, body, at = {}, b"", 12
    while at < total:
        size, kind = struct.unpack_from("<2I", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == JSON_CHUNK:
            head = json.loads(chunk)
        elif kind == BIN_CHUNK:
            body = chunk
        at += 8 + size
    return head, body


def encode_b3dm(glb: bytes, batch: dict[str, list] | None = None) -> bytes:
    table = batch_table_json(batch) if batch else b""
    total = HEADER.size + len(table) + len(glb)
    return HEADER.pack(b"b3dm", 1, total, 0, 0, len(table), 0) + table + glb


def decode_b3dm(data: bytes) -> tuple[dict, bytes, dict, dict]:
    """glTF header, glTF body, batch table, feature table."""
    h, ft, _, bt, rest = _parts(data)
    if h["magic"] != b"b3dm":
        raise TileError("not a batched model")
    head, body = decode_glb(rest)
    return head, body, bt, ft


# SQL forms


def word(n: Column) -> Column:
    """Four bytes of a number, lowest first, as hexadecimal digits."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def pnts_header_hex(ft_json: Column, ft_bin: Column, bt_json: Column | None = None) -> Column:
    bt = F.lit(0) if bt_json is None else bt_json
    words = [F.lit(1), ft_json + ft_bin + bt + 28, ft_json, ft_bin, bt, F.lit(0)]
    return F.concat(F.hex(F.lit("pnts")), *[word(w) for w in words])


def feature_table_text(n: Column, rgb: bool = False, rtc: list[Column] | None = None) -> Column:
    """The padded feature-table header of n points, as SQL."""
    parts = [F.lit('{"POINTS_LENGTH":'), n.cast("string")]
    if rtc is not None:
        parts += [F.lit(',"RTC_CENTER":['), F.concat_ws(",", *[c.cast("string") for c in rtc]), F.lit("]")]
    parts.append(F.lit(',"POSITION":{"byteOffset":0}'))
    if rgb:
        parts += [F.lit(',"RGB":{"byteOffset":'), (n * 12).cast("string"), F.lit("}")]
    text = F.concat(*parts, F.lit("}"))
    return F.concat(text, F.repeat(F.lit(" "), (F.lit(4) - F.pmod(F.length(text) + 28, F.lit(4))).cast("int")))


def read_word(content: str, at: int) -> Column:
    """The number in four bytes of a binary column, from byte `at` (0-based)."""
    return F.expr(" + ".join(f"cast(conv(hex(substring({content}, {at + i + 1}, 1)), 16, 10) as bigint) * {256**i}" for i in range(4)))


def header_columns(content: str = "content") -> list[Column]:
    names = ("version", "total", "ft_json", "ft_bin", "bt_json", "bt_bin")
    return [F.expr(f"decode(substring({content}, 1, 4), 'UTF-8')").alias("magic"), *[read_word(content, 4 + 4 * i).alias(n) for i, n in enumerate(names)]]
