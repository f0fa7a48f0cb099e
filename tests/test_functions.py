import json
import math
import struct

import numpy as np
import pytest

from voxelith.functions import codec, linalg as la, mesh


def test_golden_sizes():
    rtc = [1215012.8828876172, -4736313.051199594, 4081605.22126042]
    pts = codec.Points(np.zeros((1000, 3), "<f4"), np.zeros((1000, 3), np.uint8), rtc)
    data = codec.encode_pnts(pts)
    h = codec.header(data)
    assert (h["total"], h["ft_json"], h["ft_bin"]) == (15176, 148, 15000)
    h = codec.header(codec.encode_pnts(codec.Points(pts.xyz, None, rtc)))
    assert (h["total"], h["ft_json"], h["ft_bin"]) == (12152, 124, 12000)


@pytest.mark.parametrize("width", [0, 3, 4])
@pytest.mark.parametrize("kind", ["<f4", "<u2"])
def test_pnts_round_trip(width, kind):
    rng = np.random.default_rng(1)
    xyz = rng.integers(0, 1000, (7, 3)).astype(kind)
    rgb = rng.integers(0, 256, (7, width)).astype(np.uint8) if width else None
    back, batch = codec.decode_pnts(codec.encode_pnts(codec.Points(xyz, rgb, [1, 2, 3]), {"a": list(range(7))}))
    assert (back.xyz == xyz).all() and back.rtc == [1, 2, 3] and batch == {"a": list(range(7))}
    assert back.rgb is None if rgb is None else (back.rgb == rgb).all()
    again = codec.Points.from_features([back.feature(i) for i in range(7)], back.rtc, kind == "<u2")
    assert (again.xyz == xyz).all() and (rgb is None or (again.rgb == rgb).all())


def test_bad_tiles():
    good = codec.encode_pnts(codec.Points(np.zeros((1, 3), "<f4")))
    for bad in (b"", good[:-1], b"xxxx" + good[4:]):
        with pytest.raises(codec.TileError):
            codec.decode_pnts(bad)


def test_b3dm_round_trip():
    m = codec.Mesh(np.arange(18.0).reshape(6, 3), np.tile([0, 0, 1.0], (6, 1)), np.zeros((6, 2)))
    head, body, batch, _ = codec.decode_b3dm(codec.encode_b3dm(codec.encode_glb([m, m], texture="a.png"), {"id": [4, 5]}))
    assert batch == {"id": [4, 5]} and head["images"][0]["uri"] == "a.png"
    acc = dict(zip(head["meshes"][0]["primitives"][0]["attributes"], head["accessors"], strict=True))
    assert acc["POSITION"]["max"] == [15, 16, 17] and acc["_BATCHID"]["max"] == [1] and acc["POSITION"]["count"] == 12
    view = head["bufferViews"][0]
    assert np.allclose(np.frombuffer(body, "<f4", 36, view["byteOffset"]).reshape(-1, 3)[:6], m.positions)
    old = json.dumps({"asset": {}}).encode()
    v1 = struct.pack("<4s4I", b"glTF", 1, 20 + len(old) + 3, len(old), 0) + old + b"abc"
    assert codec.decode_glb(v1) == ({"asset": {}}, b"abc")
    single, _ = codec.decode_glb(codec.encode_glb([m, m], batched=False))
    assert len(single["meshes"]) == 2


def test_matrices():
    r = la.rotation_matrix(math.pi / 2, [0, 0, 1], [1, 0, 0])
    assert np.allclose(r @ [0, 0, 0, 1], [1, -1, 0, 1])
    angle, axis, point = la.rotation_from_matrix(r)
    assert la.is_same_transform(r, la.rotation_matrix(angle, axis, point))
    for m, back in (
        (la.reflection_matrix([1, 2, 3], [1, 1, 0]), la.reflection_from_matrix),
        (la.scale_matrix(-1.5, [1, 2, 3]), la.scale_from_matrix),
        (la.scale_matrix(2.5, [1, 2, 3], [0, 1, 1]), la.scale_from_matrix),
    ):
        make = la.reflection_matrix if back is la.reflection_from_matrix else la.scale_matrix
        assert la.is_same_transform(m, make(*back(m)))
    s = la.shear_matrix(0.4, [0, 1, 0], [0, 0, 2], [1, 0, 0])
    a, d, p, n = la.shear_from_matrix(s)
    assert la.is_same_transform(s, la.shear_matrix(a, d, p, n))
    for args in (([1, 2, 3], [0, 1, 1], None, None), ([1, 2, 3], [0, 1, 1], [1, 1, 1], None), ([1, 2, 3], [0, 1, 1], None, [4, 5, 6])):
        m = la.projection_matrix(*args)
        p, n, d, v, q = la.projection_from_matrix(m)
        assert la.is_same_transform(m, la.projection_matrix(p, n, d, v, q))
        x = m @ [3, 1, 2, 1]
        assert abs((x[:3] / x[3] - [1, 2, 3]) @ la.unit_vector([0, 1, 1])) < 1e-9
    c = la.clip_matrix(-1, 3, -2, 2, 1, 9)
    assert np.allclose(c @ [3, 2, 9, 1], [1, 1, 1, 1]) and np.allclose(c @ [-1, -2, 1, 1], [-1, -1, -1, 1])
    o = la.orthogonalization_matrix([10, 10, 10], [90, 90, 90])
    assert np.allclose(o[:3, :3], 10 * np.eye(3))
    assert math.isclose(la.orthogonalization_matrix([9.8, 12.0, 15.5], [87.2, 80.7, 69.7]).sum(), 43.063229, rel_tol=1e-6)


def test_compose_and_decompose():
    scale, shear, angles, shift = [2, 3, 4], [0.1, -0.2, 0.3], [0.3, -0.4, 0.5], [1, 2, 3]
    m = la.compose_matrix(scale, shear, angles, shift)
    got = la.decompose_matrix(m)
    for a, b in zip(got, (scale, shear, angles, shift), strict=False):
        assert np.allclose(a, b)
    assert la.is_same_transform(m, la.compose_matrix(*got))


@pytest.mark.parametrize("axes", la.AXES)
def test_euler(axes):
    rng = np.random.default_rng(2)
    for a in (*rng.uniform(-3, 3, (5, 3)), np.zeros(3)):
        m = la.euler_matrix(*a, axes)
        assert np.allclose(m, la.euler_matrix(*la.euler_from_matrix(m, axes), axes))
        q = la.quaternion_from_euler(*a, axes)
        assert np.allclose(la.quaternion_matrix(q), m)
        assert np.allclose(la.euler_matrix(*la.euler_from_quaternion(q, axes), axes), m)


def test_quaternions():
    assert np.allclose(la.quaternion_multiply([4, 1, -2, 3], [8, -5, 6, 7]), [28, -44, -14, 48])
    assert np.allclose(la.quaternion_about_axis(0.123, [1, 0, 0]), [0.99810947, 0.06146124, 0, 0])
    q = la.random_quaternion([0.2, 0.5, 0.7])
    assert math.isclose(la.vector_norm(q), 1) and la.is_same_quaternion(q, la.quaternion_from_matrix(la.quaternion_matrix(q)))
    assert np.allclose(la.quaternion_multiply(q, la.quaternion_inverse(q)), [1, 0, 0, 0])
    half = la.quaternion_slerp(q, [1, 0, 0, 0], 0.5)
    assert math.isclose(math.acos(abs(half @ q)), math.acos(abs(q[0])) / 2, rel_tol=1e-9)


@pytest.mark.parametrize("shear, scale, svd", [(True, True, True), (False, True, True), (False, False, True), (False, True, False)])
def test_superimposition(shear, scale, svd):
    rng = np.random.default_rng(3)
    a = rng.random((3, 20))
    m = la.concatenate_matrices(la.translation_matrix([1, 2, 3]), la.random_rotation_matrix([0.1, 0.2, 0.3]), la.scale_matrix(1.7 if scale else 1.0))
    b = m[:3, :3] @ a + m[:3, 3:]
    assert np.allclose(la.affine_matrix_from_points(a, b, shear, scale, svd), m)


def test_arcball():
    ball = la.Arcball()
    ball.place([320, 320], 320)
    ball.down([500, 250])
    ball.drag([475, 275])
    assert math.isclose(ball.matrix().sum(), 3.90583455, rel_tol=1e-6)
    ball = la.Arcball([1, 0, 0, 0])
    ball.place([320, 320], 320)
    ball.setaxes([1, 1, 0], [-1, 1, 0])
    ball.constrain = True
    ball.down([400, 200])
    ball.drag([200, 400])
    assert math.isclose(ball.matrix().sum(), 0.2055924, rel_tol=1e-5)
    ball.next()


def square(x, y, w):
    return np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w]], float)


@pytest.mark.parametrize(
    "rings",
    [
        [square(0, 0, 4)],
        [square(0, 0, 4)[::-1]],
        [square(0, 0, 10), square(2, 2, 3)],
        [square(0, 0, 10), square(1, 1, 2), square(5, 5, 3)[::-1], square(1, 6, 2)],
        [np.array([[0, 0], [4, 0], [4, 4], [2, 1], [0, 4]], float)],
        [np.array([[0, 0], [2, 0], [4, 0], [4, 4], [4, 4], [0, 4]], float)],
        [np.array([[math.cos(t) * (2 + k % 2), math.sin(t) * (2 + k % 2)] for k, t in enumerate(np.linspace(0, 2 * math.pi, 60, endpoint=False))])],
    ],
)
def test_triangles_cover_the_polygon(rings):
    assert mesh.deviation(rings, mesh.earcut(rings)) < 1e-9
    pts, holes, dims = mesh.flatten([r.tolist() for r in rings])
    assert mesh.unflatten(pts, holes, dims) == [r.tolist() for r in rings]


def star(rng, n, x=0.0, y=0.0, r=10.0, rough=0.3):
    t = (np.arange(n) + rng.uniform(0, 0.8, n)) * 2 * math.pi / n
    far = r * (1 - rough * rng.random(n))
    return np.c_[x + far * np.cos(t), y + far * np.sin(t)]


def test_random_polygons_with_holes():
    rng = np.random.default_rng(7)
    for n in [*range(8, 60, 3), 200, 1000]:
        holes = [star(rng, int(rng.integers(3, 15)), 3.5 * math.cos(a), 3.5 * math.sin(a), 1.2, 0.6) for a in np.arange(n % 5) * 2 * math.pi / 5]
        rings = [star(rng, n), *holes]
        cut = mesh.earcut(rings)
        assert mesh.deviation(rings, cut) < 1e-9
        assert len(cut) == sum(map(len, rings)) + 2 * len(holes) - 2


def test_an_ear_test_in_morton_order_is_the_plain_one(monkeypatch):
    rng = np.random.default_rng(8)
    rings = [star(rng, 300, rough=0.8)]
    near = mesh.earcut(rings)
    monkeypatch.setattr(mesh, "ORDERED", 10**9)
    assert mesh.earcut(rings) == near
    box = mesh._Near(rings[0])
    low, high = np.array([-3.0, 1.0]), np.array([4.0, 6.0])
    assert sorted(box.within(low, high).tolist()) == [i for i, p in enumerate(rings[0]) if (p >= low).all() and (p <= high).all()]


def test_rings_that_touch_or_cross_themselves():
    touch = np.array([[0, 0], [2, 0], [2, 2], [4, 2], [4, 4], [2, 4], [2, 2], [0, 2]], float)
    assert mesh.deviation([touch], mesh.earcut([touch])) < 1e-9
    spike = np.array([[0, 0], [4, 0], [4, 2], [7, 2], [4, 2], [4, 4], [0, 4]], float)
    assert mesh.deviation([spike], mesh.earcut([spike])) < 1e-9
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float)
    knot = np.array([[0, 0], [6, 0], [6, 4], [3, -1], [2, 4], [0, 4]], float)
    twice = np.vstack([square(0, 0, 4), square(0, 0, 4)])
    for ring in (bow, knot, twice, np.zeros((5, 2)), star(np.random.default_rng(1), 50)[np.random.default_rng(2).permutation(50)]):
        assert all(len(set(t)) == 3 for t in mesh.earcut([ring]))
    assert sum(abs(mesh._turn(*knot[list(t)])) / 2 for t in mesh.earcut([knot])) > 12
    crossed = [square(0, 0, 4), square(3, 1, 2)]  # the hole leaves the outside
    assert mesh.earcut(crossed)


def test_polygons_in_space():
    wall = np.array([[0, 0, 0], [0, 4, 0], [0, 4, 3], [0, 0, 3]], float)
    uv = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    tri, tex = mesh.triangulate([wall], [[uv]])
    assert tri.shape == (2, 3, 3) and tex.shape == (2, 3, 2)
    assert np.allclose(mesh.normals(tri), [[1, 0, 0]] * 6)
    assert np.allclose(mesh.normals(np.zeros((1, 3, 3))), [[0, 0, 1]] * 3)
    back = mesh.read_wkb(mesh.write_wkb([[wall], [wall + 1]]))
    assert np.allclose(back[1][0], wall + 1)
    flat = struct.pack(">BIII", 0, 3, 1, 4) + np.array([[0, 0], [1, 0], [0, 1], [0, 0]], ">f8").tobytes()
    assert mesh.read_wkb(flat)[0][0].tolist() == [[0, 0, 0], [1, 0, 0], [0, 1, 0]]
    assert mesh.earcut([np.zeros((2, 2))]) == []


def test_crossings_of_a_few_segments_in_plain_numbers():
    rng = np.random.default_rng(2)
    for _ in range(500):
        p, q = rng.integers(0, 5, (2, 2)).astype(float)
        a, b = rng.integers(0, 5, (2, 3, 2)).astype(float)
        assert mesh._meets(p.tolist(), q.tolist(), list(zip(a.tolist(), b.tolist(), strict=True))) == mesh.crossings(p, q, a, b).any()
    p, q, a = np.zeros(2), np.array([4.0, 0]), np.array([[2.0, 0], [4, 0], [1, -1], [5, -1]])
    assert mesh.crossings(p, q, a, np.array([[2.0, 3], [4, 3], [1, 1], [5, 1]])).tolist() == [True, False, True, False]
