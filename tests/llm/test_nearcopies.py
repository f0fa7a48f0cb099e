import re

import numpy as np
import xxhash

from voxelith.llm import nearcopies


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def fingerprint(held):
    """256 bits, one at a time."""
    m, out = 2**64 - 1, 0
    for k in range(4):
        hs = []
        for x in held:
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            if k:
                h = (h + k * 0x9E3779B97F4A7C15) & m
                h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
                h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
                h ^= h >> 31
            hs.append(h)
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) << 64 * k
    return out


def exact(rows):
    """Groups of doc_ids by a search of all pairs."""
    known, sets = {}, []
    for _, t in rows:
        held = frozenset(shingles(t))
        if held not in known:
            known[held] = len(known)
        sets.append(held)
    kinds = list(known)
    prints = [fingerprint(x) for x in kinds]
    words = np.array([[p >> 64 * k & (2**64 - 1) for k in range(4)] for p in prints], np.uint64)
    sizes = np.array([len(x) for x in kinds])
    parent = list(range(len(kinds)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(kinds)):
        far = np.bitwise_count(words[i] ^ words[:i]).sum(axis=1)
        near = (far <= 51) & (np.minimum(sizes[:i], sizes[i]) >= 0.64 * np.maximum(sizes[:i], sizes[i])) & (sizes[:i] > 0) & (sizes[i] > 0)
        for j in np.nonzero(near)[0].tolist():
            parent[find(i)] = find(j)
    groups = {}
    for (d, _), held in zip(rows, sets, strict=True):
        groups.setdefault(find(known[held]), []).append(d)
    return sorted(sorted(g) for g in groups.values())


def found(df, **how):
    groups = {}
    for r in nearcopies.near_copies(df, **how).collect():
        groups.setdefault(r["group"], []).append(r["doc_id"])
    return sorted(sorted(g) for g in groups.values())


def text(n, edits=(), of="w"):
    return " ".join(f"x{i}" if i in edits else f"{of}{i}" for i in range(n))


def test_copies_and_others(spark, odd, empty):
    # Of 200 words: 196 shingles; an edit in the middle changes 5 of them, so 4 edits leave a Jaccard
    # likeness of 176 / 216 = 0.81, and 25 edits 71 / 321 = 0.22.
    base = text(200)
    near, far = text(200, (20, 60, 100, 140)), text(200, range(8, 200, 8), "v")
    assert jaccard(base, near) >= 0.8 and jaccard(text(200, (), "v"), far) < 0.3
    rows = [(1, base), (2, near), (3, text(200, (), "v")), (4, far), (5, base.upper() + " \t"), (6, None), (7, ""), (8, "one two"), (9, "one  Two")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == [[1, 2, 5], [3], [4], [6, 7], [8, 9]]
    assert nearcopies.near_copies(odd).count() == odd.count()
    assert nearcopies.near_copies(empty).count() == 0


def test_groups_of_documents_are_those_of_a_search_of_all_pairs(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = exact([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sum(len(g) > 1 for g in want) > 30
    assert found(df) == want
    monkeypatch.setattr(nearcopies, "TILES", 2)
    assert found(df, tile=20) == want


def test_a_large_group_of_near_copies_costs_rows_in_proportion(spark):
    """Each edits another two places of one text: 1225 and 4950 pairs, 49 and 99 edges."""
    for n in (50, 100):
        held = [nearcopies.shingles(text(400, (7 * i % 397, 11 * i % 397 + 1))) for i in range(n)]
        tile = {"node": np.arange(n), "size": np.array([len(x) for x in held])}
        tile |= {f"w{k}": np.array([nearcopies.majority(nearcopies.mixed(x, k)) for x in held], np.int64).view(np.uint64) for k in range(4)}
        a, b = nearcopies.forest(tile, tile, True, 51, 0.64)
        assert len(a) == n - 1 and set(b.tolist()) == {0}
    rows = [(i, text(400, (7 * i % 397, 11 * i % 397 + 1))) for i in range(300)]
    assert len(found(spark.createDataFrame(rows, "doc_id long, text string"), tile=40)) == 1


def test_odd_columns(spark):
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (2, None, 2, "y"), (3, "long " * 300 + "w " * 1_000_000, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, key string")
    assert found(df) == [[1, 1], [2], [3]]


def test_near_stage_removes_near_copies(spark):
    import corpus_pipeline as p

    rows = [(1, text(200), "s"), (2, text(200, (20, 60, 100, 140)), "s"), (3, text(200, (), "v"), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in p.near_stage(spark, df, "").collect()) == [1, 3]


def test_near_stage_goes_by_rows(spark):
    """An id that two texts share, equal rows, and copies without an id."""
    import corpus_pipeline as p

    a, b, c, d = (text(200, (), of) for of in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, p.near_stage(spark, df, "").collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, d)], key=str)
