import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import codec, crs, index, mesh
from voxelith.operators import lod, tiling
from voxelith.plans import convert, export, info, merge
from voxelith.sources import las, tiles, xyz


def cloud(n, seed=0, flat=False):
    rng = np.random.default_rng(seed)
    return rng.random((n, 3)) * [100, 100, 10 if flat else 100]


def brute(points, spacing):
    kept = []
    for i, p in enumerate(points):
        if all(np.sum((p - points[j]) ** 2) >= spacing**2 for j in kept):
            kept.append(i)
    return kept


def test_greedy_is_the_sequential_rule():
    p = cloud(400) / 10
    assert np.nonzero(lod.greedy(p, np.zeros((0, 3)), 1.5))[0].tolist() == brute(p, 1.5)
    first = lod.greedy(p[:200], np.zeros((0, 3)), 1.5)
    second = lod.greedy(p[200:], p[:200][first], 1.5)
    assert np.nonzero(np.concatenate([first, second]))[0].tolist() == brute(p, 1.5)
    assert lod.greedy(np.zeros((2, 3)), np.zeros((0, 3)), 1.0).tolist() == [True, False]


def test_a_point_is_compared_with_the_kept_ones_around_it():
    """Beside 64 times as many kept points the same points take about as long."""
    rng = np.random.default_rng(4)
    p = rng.integers(0, 7, (20000, 3)) + 0.45 + rng.random((20000, 3)) / 10
    side = np.arange(32) * 1.0
    held = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    took = []
    for h in (held[(held < 8).all(axis=1)], held):
        lod.greedy(p[:10], h, 0.5)
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            kept = lod.greedy(p, h, 0.5)
            runs.append(time.perf_counter() - start)
        took.append(min(runs))
        assert kept.sum() == 343
    assert took[1] < 12 * took[0]


def test_what_is_near_no_number_is_kept():
    p = np.array([[np.nan, 0, 0], [0, 0, 0], [0.5, 0, 0], [np.inf, 0, 0], [np.inf, 0, 0], [1e308, 0, 0], [-1e308, 0, 0], [1e308, 0.5, 0]])
    assert lod.greedy(p, np.zeros((0, 3)), 1.0).tolist() == [True, True, False, True, True, True, True, False]
    assert lod.greedy(p, p[:2], 1.0).tolist() == [True, False, False, True, True, True, True, False]


def test_groups_of_one_hash_are_held_apart(spark, monkeypatch):
    p = np.random.default_rng(8).random((3000, 3)) * [9, 5, 3]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "seq long, x double, y double, z double")
    plain = sorted(lod.build(df, 100).collect())
    monkeypatch.setattr(lod, "CODES", 1)
    assert sorted(lod.build(df, 100).collect()) == plain


def test_levels_hold_every_point_once(spark):
    p = cloud(3000, flat=True)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "seq long, x double, y double, z double")
    out = lod.build(df, 300, order=("seq",)).collect()
    assert sorted(r["seq"] for r in out) == list(range(3000))
    assert all(len(r["path"]) == r["depth"] and set(r["path"]) <= set("0246") for r in out)
    # Kept points of an inner tile's cell keep their distance.
    root = np.linalg.norm(p.max(axis=0) - p.min(axis=0)) / 125
    inner = {r["path"][:-1] for r in out if r["depth"] > 1}
    for t in inner:
        own = p[[r["seq"] for r in out if r["path"] == t]]
        box = index.box_of_path(spark.createDataFrame([(t,)], "path string"), index.bounds(df), len(t)).first()
        low, high = (np.array([box[f"{c}{i}"] for c in "xyz"]) for i in (0, 1))
        cell = np.clip((3 * (own - low) / (high - low)).astype(int), 0, 2)
        for c in np.unique(cell, axis=0):
            q = own[(cell == c).all(axis=1)]
            gap = np.linalg.norm(q[:, None] - q[None], axis=2) + np.eye(len(q)) * 1e9
            assert not len(q) or gap.min() >= root / 2 ** len(t) * (1 - 1e-9)


def test_degenerate_clouds(spark):
    schema = "seq long, x double, y double, z double"
    assert lod.build(spark.createDataFrame([], schema), 10).count() == 0
    one = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(30)], schema)
    assert lod.build(one, 10, 3, ("seq",)).count() == 30
    assert tiling.metadata(one).first()["subdivision"] == "OCTREE"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("clouds")
    p = cloud(600, 5)
    las.write_las(f"{d}/a.las", p, (cloud(600, 6) * 600).astype(np.uint16))
    with open(d / "b.xyz", "w") as f:
        f.writelines(f"{x} {y} {z} {int(x)} {int(y)} {int(z)}\n" for x, y, z in cloud(200, 7))
        f.write("not a point\n1 2\n")
    return d, p


def test_sources(spark, files):
    d, p = files
    got = las.read_las(spark, f"{d}/a.las", 250).orderBy("seq").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], p, atol=0.001) and max(r["r"] for r in got) > 100
    assert las.metadata(spark, f"{d}/a.las").first()["n"] == 600
    pts = xyz.read_xyz(spark, f"{d}/b.xyz")
    assert pts.count() == 200 and xyz.metadata(pts).first()["n"] == 200
    lines = spark.createDataFrame([("1 2 3",), ("1 2 3 4",), ("1 2 3 4 5 6",), ("1 2 3 9 4 5 6",), ("1 2",), ("a b c",)], "value string")
    got = [tuple(r) for r in lines.select(*xyz.parse()).collect()]
    assert got[:4] == [(1, 2, 3, None, None, None, None), (1, 2, 3, 4, None, None, None), (1, 2, 3, None, 4, 5, 6), (1, 2, 3, 9, 4, 5, 6)]
    assert got[4][0] is None and got[5][0] is None


def points_of(spark, folder):
    return tiles.tile_points(tiles.read_tiles(spark, folder))


def test_convert_then_merge(spark, files, tmp_path):
    d, _ = files
    a, b = f"file://{tmp_path}/m/a", f"file://{tmp_path}/m/b"
    done = convert.convert(spark, [f"{d}/a.las", f"{d}/b.xyz"], a, convert.Options(threshold=200, compact=10))
    assert done["points"] == 800
    doc = json.load(open(f"{tmp_path}/m/a/tileset.json"))
    assert doc["root"]["refine"] == "REPLACE" and doc["root"]["content"]["uri"] == "r.pnts" and len(doc["root"]["transform"]) == 16
    names, todo = [], [doc["root"]]
    while todo:
        n = todo.pop()
        names.append(n["content"]["uri"])
        todo += n.get("children", [])
    tiled = points_of(spark, a).where("uri not like '%/r.pnts'")
    assert tiled.count() == 800 and all((tmp_path / "m/a" / n).exists() for n in names)
    with pytest.raises(FileExistsError):
        convert.convert(spark, [f"{d}/b.xyz"], a)
    convert.convert(spark, [f"{d}/b.xyz"], b, convert.Options(fraction=50, rgb=False))
    part = points_of(spark, b).count()  # folded into the root
    assert 50 < part < 150
    assert merge.merge(spark, f"file://{tmp_path}/m")["tilesets"] == 2
    both = json.load(open(f"{tmp_path}/m/tileset.json"))
    refs = json.dumps(both)
    assert "a/tileset.json" in refs and "b/tileset.json" in refs
    with pytest.raises(FileExistsError):
        merge.merge(spark, f"file://{tmp_path}/m")
    merge.remove(f"file://{tmp_path}/m")
    assert not (tmp_path / "m/tileset.json").exists() and (tmp_path / "m/a/tileset.json").exists()
    shown = info.info(spark, a).first()
    assert shown["kind"] == "POINTCLOUD" and shown["version"] == 1
    raw = (tmp_path / "m/a/r.pnts").read_bytes()
    assert "First point" in info.describe(raw) and info.to_hex(raw[:4]) == "70 6E 74 73"


def test_merged_leaves_stay_where_they_are():
    def tileset(shift, scale):
        m = np.diag([scale, scale, scale, 1.0])
        m[:3, 3] = shift
        turn = np.array([[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
        root = {"transform": (m @ turn).T.ravel().tolist(), "boundingVolume": {"box": [1, 2, 3, 1, 0, 0, 0, 2, 0, 0, 0, 3]}, "geometricError": 1.0}
        return json.dumps({"geometricError": 1.0, "root": root})

    sets = [{"id": i, **merge.describe(f"file:///d/{i}/tileset.json", tileset(t, c))} for i, (t, c) in enumerate([((100, 20, 3), 0.5), ((-7, 400, 9), 2.0)])]
    matrix = lambda v: np.array(v).reshape(4, 4).T
    doc = merge.assemble(sets, {0: "0", 1: "3"}, matrix(sets[0]["transform"]), "file:///d", False)
    leaves = {c["content"]["uri"]: c for c in doc["root"]["children"]}
    for s in sets:
        leaf = leaves[f"{s['id']}/tileset.json"]
        frame = matrix(doc["root"]["transform"]) @ matrix(leaf["transform"])
        assert np.allclose(frame @ matrix(s["transform"]), matrix(s["transform"]))
        world = np.c_[merge.box_corners(leaf["boundingVolume"]["box"]), np.ones(8)] @ frame.T
        assert np.allclose(merge.to_box(world[:, :3]), [s[k] for k in index.BOX])


def world(folder, uri="tileset.json", above=None):
    """(content file, points in the world) of a tileset and those it refers to, transforms composed."""
    above = np.eye(4) if above is None else above
    todo = [(json.load(open(folder / uri))["root"], above)]
    while todo:
        n, m = todo.pop()
        m = m @ np.array(n.get("transform") or np.eye(4).ravel().tolist()).reshape(4, 4).T
        todo += [(c, m) for c in n.get("children", [])]
        name = (n.get("content") or {}).get("uri")
        if name and name.endswith(".json"):
            yield from world((folder / uri).parent, name, m)
        elif name:
            p = codec.decode_pnts(((folder / uri).parent / name).read_bytes())[0]
            yield (folder / uri).parent / name, np.c_[p.xyz.astype(float) + np.array(p.rtc or [0, 0, 0]), np.ones(len(p))] @ m.T


def test_merged_clouds_lie_where_their_points_are(spark, tmp_path):
    """Two clouds far apart, of different scales, converted and merged; all points come back."""
    clouds = {"a": cloud(300, 1) + [1000, 2000, 30], "b": cloud(200, 2) * 40 + [50000, -700, 5]}
    for name, p in clouds.items():
        df = spark.createDataFrame([("s", i, *map(float, v), 1, 2, 3) for i, v in enumerate(p)], "src string, seq long, x double, y double, z double, r int, g int, b int")
        convert.convert_points(df, f"file://{tmp_path}/m/{name}", convert.Options(threshold=100, compact=5))
    assert merge.merge(spark, f"file://{tmp_path}/m")["tiles"] == 1
    found = list(world(tmp_path / "m"))
    for name, p in clouds.items():
        tiled = np.concatenate([x[:, :3] for f, x in found if f.parent.name == name and f.name != "r.pnts"])
        top = np.concatenate([x[:, :3] for f, x in found if f.parent.name == name and f.name == "r.pnts"])
        every = np.concatenate([tiled, top])
        gap = np.abs(every[:, None] - p[None]).max(axis=2)
        assert gap.min(axis=0).max() < 0.05 and gap.min(axis=1).max() < 0.05
    over = np.concatenate([x[:, :3] for f, x in found if f.parent.name == "m"])
    assert len(over) and np.abs(over[:, None] - np.concatenate(list(clouds.values()))[None]).max(axis=2).min(axis=1).max() < 0.1


def test_overviews_take_an_even_share(spark):
    rows = [(q, k, *map(float, v)) for q, most in (("", 9000), ("0", 300)) for k, share in ((1, 0.75), (2, 0.25)) for v in cloud(int(most * share), k)]
    df = spark.createDataFrame(rows, "path string, id int, x double, y double, z double")
    got = merge.overview(df, most=1000)
    n = {(r["path"], r["id"]): r["count"] for r in got.groupBy("path", "id").count().collect()}
    assert n == {("", 1): 750, ("", 2): 250, ("0", 1): 112, ("0", 2): 37}
    ranked = df.withColumn("h", F.xxhash64("x", "y", "z")).collect()
    for (q, k), m in n.items():
        want = sorted((r["h"], r["x"]) for r in ranked if (r["path"], r["id"]) == (q, k))[:m]
        assert sorted(x for _, x in want) == sorted(r["x"] for r in got.where((F.col("path") == q) & (F.col("id") == k)).collect())


def test_quadrants_end_at_a_small_diagonal():
    box = {"x0": 0.0, "y0": 0.0, "z0": 0.0, "x1": 3.0, "y1": 4.0, "z1": 9.0}
    assert merge.levels(box) == 3 and 5 / 2**3 < merge.LEAST_DIAGONAL <= 5 / 2**2
    assert merge.levels(box | {"x1": 0.0, "y1": 0.0}) == 0 and merge.levels(box | {"x1": 1e9}) == 12


def test_tiles_divide_down_to_a_thousandth_before_scaling(spark):
    """A cloud three kilometres wide with 300 points in five centimetres."""
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random((100, 3)) * 3000, rng.random((300, 3)) * 0.05 + 1000])
    df = spark.createDataFrame([("s", i, *map(float, v), 0, 0, 0) for i, v in enumerate(p)], "src string, seq long, x double, y double, z double, r int, g int, b int")
    plain = lod.build(df, 20, order=("seq",))
    scaled, meta = convert.prepare(df, convert.Options())
    assert meta["scale"] == 0.01
    again = lod.build(scaled, 20, order=("src", "seq"), scale=meta["scale"])
    depth = [d.agg(F.max("depth")).first()[0] for d in (plain, again)]
    assert depth[0] == depth[1] >= 14


def test_points_in_one_place_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiles, "FILE_POINTS", 70)
    monkeypatch.setattr(tiles.encode_tiles, "__defaults__", (*tiles.encode_tiles.__defaults__[:-1], 70))
    p = np.concatenate([np.full((300, 3), 5.0), cloud(100, 3)])
    df = spark.createDataFrame([("s", i, *map(float, v), 1, 2, 3) for i, v in enumerate(p)], "src string, seq long, x double, y double, z double, r int, g int, b int")
    done = convert.convert_points(df, f"file://{tmp_path}/c", convert.Options(threshold=200, compact=5))
    found = list(world(tmp_path / "c"))
    assert len(found) == done["tiles"] and len({f for f, _ in found}) == len(found) and all(len(x) <= 70 for _, x in found)
    tiled = [(f, x) for f, x in found if not (f.name == "r.pnts" or f.name.startswith("r_"))]
    assert 390 <= sum(len(x) for _, x in tiled) <= 400 and any("_4.pnts" in f.name for f, _ in tiled)


def test_z_up_features_come_back(spark, tmp_path):
    """What a viewer does with a model (x, -z, y) and the tileset's transform gives the input."""
    rings = [np.array([[0, 0, 1], [5, 0, 2], [5, 5, 3], [0, 5, 2]], float) + [1000 + 10 * i, 50 * i, 7] for i in range(3)]
    df = spark.createDataFrame([(i, mesh.write_wkb([[r]])) for i, r in enumerate(rings)], "fid long, wkb binary")
    export.export_z_up(df, f"file://{tmp_path}/out")
    doc = json.load(open(tmp_path / "out/tileset.json"))
    got, low, high = [], [], []
    for f in (tmp_path / "out/tiles").iterdir():
        head, body, _, _ = codec.decode_b3dm(f.read_bytes())
        acc = head["accessors"][head["meshes"][0]["primitives"][0]["attributes"]["POSITION"]]
        v = np.frombuffer(body, "<f4", 3 * acc["count"], head["bufferViews"][acc["bufferView"]]["byteOffset"]).reshape(-1, 3)
        got.append(np.c_[v[:, 0], -v[:, 2], v[:, 1]] + doc["root"]["transform"][12:15])
    got, want = np.concatenate(got), np.concatenate(rings)
    gap = np.abs(got[:, None] - want[None]).max(axis=2)
    assert gap.min(axis=0).max() < 0.01 and gap.min(axis=1).max() < 0.01
    box = doc["root"]["boundingVolume"]["box"]
    centre = np.array(box[:3]) + doc["root"]["transform"][12:15]
    assert np.allclose(centre, (want.min(axis=0) + want.max(axis=0)) / 2, atol=0.01) and np.allclose([box[3], box[7], box[11]], np.ptp(want, axis=0) / 2, atol=0.01)


def test_source_system_is_needed(spark):
    df = spark.createDataFrame([("s", 0, 2.0, 48.0, 10.0, 0, 0, 0)], "src string, seq long, x double, y double, z double, r int, g int, b int")
    with pytest.raises(crs.SourceSystemMissing):
        convert.prepare(df, convert.Options(srs_out="4978"))
    out, meta = convert.prepare(df, convert.Options(srs_in="4326", srs_out="4978"))
    assert np.allclose(meta["transform"][:3, 3], meta["offset"]) and out.first()["x"] == 0


def test_ecef(spark):
    lon, lat, h = (F.lit(v) for v in (-75.61200462622627, 40.03886513981721, 2848.448771114095))
    got = spark.range(1).select(*crs.to_ecef(lon, lat, h)).first()
    assert np.allclose(got, (1215626.30684538, -4738673.45914053, 4083122.83975827), atol=1e-6)


def test_export(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for i in range(30):
        ring = np.array([[0, 0, 0], [5, 0, 0], [5, 5, 0], [0, 5, 0]], float) + [i * 30, i % 3 * 40, i]
        (tmp_path / f"w/{i:02}.wkb").write_bytes(mesh.write_wkb([[ring]]))
    done = export.export_directory(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/out", (1, 2, 3))
    doc = json.load(open(tmp_path / "out/tileset.json"))
    assert done["features"] == 30 and doc["root"]["transform"][12:15] == [1, 2, 3]
    found = [p.read_bytes() for p in (tmp_path / "out/tiles").iterdir()]
    assert sum(len(codec.decode_b3dm(b)[2]["id"]) for b in found) == 30 and len(found) == done["tiles"] >= 2


def test_parts_are_dealt_to_all_tasks(spark):
    """A table in one file becomes polygons in as many tasks as a shuffle has."""
    from voxelith import queries

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = queries._footprints(spark, "/root/testdata/sf0.001")
    rows = made.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(rows) == n and min(rows) > 0 and sum(rows) == 200


def test_files_do_not_depend_on_batches(spark, monkeypatch):
    """Nodes that begin and end within batches, and nodes of several batches; nodes as groups of a frame."""
    rng = np.random.default_rng(6)
    rows = [(f, t, *map(float, rng.random(12))) for f in range(60) for t in range(1 + f % 5)]
    names = [f"{v}{c}" for v in "abc" for c in "xyz"] + ["nx", "ny", "nz"]
    tri = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "fid long, tri long, " + ", ".join(f"{c} double" for c in names))
    node = {f: "1_1" if f < 30 else f"1_2_{f % 7}" for f in range(60)}
    placed = spark.createDataFrame(list(node.items()), "fid long, node string")
    monkeypatch.setattr(export, "FILES_BYTES", 1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["name"]: bytes(r["content"]) for r in export.encode_nodes(tri, placed).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for n in set(node.values()):
        ids = [f for f in node if node[f] == n]
        meshes = []
        for f in ids:
            g = np.array([r[2:] for r in rows if r[0] == f])
            meshes.append(codec.Mesh(g[:, :9].reshape(-1, 3), np.repeat(g[:, 9:], 3, axis=0)))
        want[f"tiles/{n}.b3dm"] = codec.encode_b3dm(codec.encode_glb(meshes), {"id": ids})
    assert got == want


def test_textured_features(spark, tmp_path):
    """Texture places go with their points into the file; a feature without has zeros."""
    square = np.array([[0, 0, 0], [10, 0, 0], [10, 0, 10], [0, 0, 10]], float)
    uv = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], float)
    df = spark.createDataFrame([(1, mesh.write_wkb([[square]]), mesh.write_wkb([[uv]])), (2, mesh.write_wkb([[square + 20]]), None)], "fid long, wkb binary, uv binary")
    export.export_features(df, f"file://{tmp_path}/out", texture="square.jpg")
    (file,) = (tmp_path / "out/tiles").iterdir()
    head, body, batch, _ = codec.decode_b3dm(file.read_bytes())
    assert head["images"][0]["uri"] == "square.jpg" and sorted(batch["id"]) == [1, 2]
    acc = dict(zip(head["meshes"][0]["primitives"][0]["attributes"], head["accessors"], strict=True))
    read = lambda k, n: np.frombuffer(body, "<f4", n * acc[k]["count"], head["bufferViews"][acc[k]["bufferView"]]["byteOffset"]).reshape(-1, n)
    first = read("_BATCHID", 1)[:, 0] == batch["id"].index(1)
    assert np.allclose(read("TEXCOORD_0", 2)[first], read("POSITION", 3)[first][:, [0, 2]] / 10) and first.sum() == 6
    assert not read("TEXCOORD_0", 2)[~first].any()
    with pytest.raises(ValueError):
        export.export_features(df.drop("uv"), f"file://{tmp_path}/no", texture="square.jpg")


def test_planes_and_back(spark):
    df = spark.createDataFrame([(2.0, 48.0, 5.0), (3.0, 0.0, 0.0), (5.9, -79.0, 1.0), (0.1, 83.0, 2.0)], "x double, y double, z double")
    for epsg in (3857, 32631, 32731):
        there = df.select("x", "y", *[c.alias(n) for c, n in zip(crs.reproject(F.col("x"), F.col("y"), F.col("z"), 4326, epsg), "uvw", strict=True)])
        back = there.select("x", "y", *[c.alias(n) for c, n in zip(crs.reproject(F.col("u"), F.col("v"), F.col("w"), epsg, 4326)[:2], "ab", strict=True)])
        for r in back.collect():
            assert abs(r["a"] - r["x"]) < 1e-8 and abs(r["b"] - r["y"]) < 1e-8
    with pytest.raises(crs.UnknownSystem):
        crs.reproject(F.lit(0.0), F.lit(0.0), F.lit(0.0), 4326, 32661)


def test_external_subtrees(monkeypatch):
    monkeypatch.setattr(tiles, "EXTERNAL_CHARS", 500)
    rows = [{"path": p, "uri": f"r{p}.pnts", "x0": 0.0, "y0": 0.0, "z0": 0.0, "x1": float(len(p)), "y1": 1.0, "z1": 1.0} for p in ("0", "00", "01", "02", "4", "444")]
    out = tiles.tileset_json(rows, 1.0, 1.0, [1.0] * 16, "r.pnts")
    assert {"tileset.json", "tileset.0.json"} <= set(out)
    top = json.loads(out["tileset.json"])
    assert top["root"]["boundingVolume"]["box"][3] == 1.5 and any(c["content"]["uri"] == "tileset.0.json" for c in top["root"]["children"])


def test_subtrees_folded_on_executors_are_those_of_the_driver(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    paths = {"".join(rng.choice(list("02467"), k)) for k in rng.integers(1, 9, 400)}
    rows = []
    for p in sorted(paths):
        low = rng.random(3)
        rows.append({"path": p, "uri": f"r{p}.pnts", "more": [f"r{p}_1.pnts"] if p.endswith("7") else [], **dict(zip(index.BOX, [*low.tolist(), *(low + rng.random(3)).tolist()], strict=True))})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "path string, uri string, more array<string>, " + ", ".join(f"{k} double" for k in index.BOX))
    want = tiles.tileset_json(rows, 1.0, 0.5, [1.0] * 16, "r.pnts")
    below = tiles.fold_tiles(df, 1.0, 0.5, f"file://{tmp_path}/t").collect()
    given = {r["path"]: (json.loads(r["node"]), r["size"], list(r["box"])) for r in below}
    got = tiles.tileset_json([r for r in rows if len(r["path"]) <= tiles.FOLD_AT], 1.0, 0.5, [1.0] * 16, "r.pnts", given)
    assert {k: json.loads(v) for k, v in got.items()} == {k: json.loads(v) for k, v in want.items()}


def test_command_line(spark, tmp_path, capsys):
    from voxelith.__main__ import main

    for name, shift in (("a", 0), ("b", 900)):
        (tmp_path / f"{name}.xyz").write_text("".join(f"{x + shift} {y} {z} 1 2 3\n" for x, y, z in cloud(60, 4)))
        out = f"file://{tmp_path}/m/{name}"
        assert main(["convert", f"{tmp_path}/{name}.xyz", "--out", out, "--benchmark", "run"]) == 0
        assert capsys.readouterr().out.startswith("run,") and main(["convert", f"{tmp_path}/{name}.xyz", "--out", out]) == 1
    assert main(["merge", f"file://{tmp_path}/m"]) == 0 and main(["merge", f"file://{tmp_path}/m"]) == 1
    assert main(["merge", f"file://{tmp_path}/m", "--overwrite", "true"]) == 0
    capsys.readouterr()
    assert main(["info", f"file://{tmp_path}/m/a"]) == 0
    assert "Points: 60" in capsys.readouterr().out
    (tmp_path / "w").mkdir()
    ring = np.array([[0, 0, 0], [5, 0, 0], [5, 0, 5], [0, 0, 5]], float)
    (tmp_path / "w/one.wkb").write_bytes(mesh.write_wkb([[ring]]))
    assert main(["export", "--directory", f"file://{tmp_path}/w", "--out", f"file://{tmp_path}/e", "--offset", "1", "2", "3"]) == 0
    assert main(["info", f"file://{tmp_path}/e"]) == 0 and "Magic value: b3dm" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    from voxelith.streaming import ingest

    box = dict(zip(index.BOX, (0.0, 0.0, 0.0, 100.0, 100.0, 100.0), strict=True))
    p = cloud(500, 9)
    df = spark.createDataFrame([(*map(float, v), i) for i, v in enumerate(p)], "x double, y double, z double, t long").withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = ingest.running_counts(stream, box, 2).writeStream.outputMode("complete").format("memory").queryName("tiles_so_far").start()
    q.processAllAvailable()
    q.stop()
    got = {r["path"]: r["n"] for r in spark.table("tiles_so_far").collect()}
    root = spark.createDataFrame([tuple(box.values())], ", ".join(f"{k} double" for k in index.BOX))
    want = {r["path"]: r["count"] for r in index.with_paths(df.select("x", "y", "z"), 2, root).groupBy("path").count().collect()}
    assert got == want
    q = ingest.complete_tiles(stream, box, 1, "ts").writeStream.outputMode("append").format("memory").queryName("tiles_done").start()
    q.processAllAvailable()
    q.stop()
    done = spark.sql("select sum(n) as n, max(window.end) as e from tiles_done").first()
    assert 0 < done["n"] < 500
