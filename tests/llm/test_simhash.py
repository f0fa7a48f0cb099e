import re

import numpy as np
import pytest
import xxhash

from voxelith.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    prints = [(d, fp(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{x:016x}", low.get(find(i))) for i, (d, x) in enumerate(prints)), key=str)


def got(df, **k):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, **k).collect()), key=str)


def test_against_brute_force(docs, odd, empty):
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got(empty) == []


def test_clashing_columns_and_hot_fingerprints(spark):
    rows = [(i, "the same words in every row", 3, "f") for i in range(3000)] + [(5000 + i, f"own {i} words {i * i} of row {i} here", 1, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string").repartition(7)
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "fp", "fingerprint", "component_id"]
    assert got(df) == brute([r[:2] for r in rows])


def test_parts_follow_the_number_of_classes():
    assert [simhash.parts_for(n, 2) for n in (0, 10**5, 10**9, 10**11)] == [4, 4, 8, 16]
    assert simhash.parts_for(10**12, 8) < 16  # cells' numbers would not fit


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("parts", [4, 8, 16])
def test_pairs_over_many_tiles(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 300)
    near = [(int(x) ^ signed(1 << int(b)) ^ signed(1 << int(c))) for x, b, c in zip(base, rng.integers(0, 64, 300), rng.integers(0, 64, 300), strict=True)]
    near += [int(x) ^ signed(1 << 63) ^ (1 << k) for k, x in enumerate(base[:60])]
    fps = sorted({*map(int, base), *near, *[0, 1, 3, 7, -1, -2, signed(1 << 63)]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_pairs(df, tile=4, parts=parts).collect()}
    m = (1 << 64) - 1
    assert pairs == {(x, y) for i, x in enumerate(fps) for y in fps[i + 1 :] if ((x ^ y) & m).bit_count() <= 2}
    assert simhash.near_pairs(df, tile=4, parts=parts).count() == len(pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
