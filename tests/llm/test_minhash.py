import hashlib
import random
import re

import xxhash

from voxelith.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def edited(t, nxt):
    k = len(t) // 4
    return t[: len(t) - k] + nxt[:k]


def check(df, loose):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(minhash.edited_pairs(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    errors = []
    for i, ((d, t), r) in enumerate(zip(rows, got, strict=True)):
        nxt = rows[(i + 1) % len(rows)][1]
        e = edited(t, nxt)
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t), hashlib.sha256(e.encode()).hexdigest())
        for x, y in ((r["near_edited"], e), (r["near_next"], nxt)):
            a, b = shingles(t), shingles(y)
            errors.append(abs(x - len(a & b) / len(a | b)))
            assert 0 <= x <= 1
    assert max(errors) < loose
    return sum(errors) / len(errors)


def test_edited_pairs(docs):
    assert check(docs, 0.25) < 0.03


def test_odd_rows(odd, empty):
    check(odd, 0.35)
    assert minhash.edited_pairs(empty).count() == 0
    assert minhash.fingerprints(odd).count() == odd.count()


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x " * 50), (4, "x " * 50)], "doc_id long, text string")
    fp = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(df).collect()}
    assert fp[1] == fp[2] != fp[3] == fp[4] and len(fp[1]) == 2**minhash.BIN_BITS * minhash.STORED_BITS // 4


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """Spark's xxhash64 of several strings: each one's hash is the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return signed(seed)


def signature(text, bin_bits=minhash.BIN_BITS, stored=minhash.STORED_BITS):
    """Bins of minima, densified and cut to their low bits, one step at a time."""
    w = WORD.findall(text or "")
    hashes = [spark_hash(" ".join(w))] if len(w) < 5 else [spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)]
    n, low = 2**bin_bits, 64 - bin_bits
    bins = [None] * n
    for h in hashes:
        b, rest = (h >> low) + n // 2, h & ((1 << low) - 1)
        bins[b] = rest if bins[b] is None else min(bins[b], rest)
    draw = random.Random(11)
    orders = [[draw.randrange(n) for _ in range(n)] for _ in range(minhash.PROBES)]

    def donor(i):
        for t in orders:
            if bins[t[i]] is not None:
                return bins[t[i]]
        full = [j for j in range(n) if bins[j] is not None]
        ranks = {j: xx_ints(i, j) for j in full}
        return bins[min(full, key=lambda j: (ranks[j], bins[j]))]

    return [(x if x is not None else donor(i)) & (2**stored - 1) for i, x in enumerate(bins)]


def xx_ints(i, j):
    """Spark's xxhash64 of two integers."""
    seed = 42
    for v in (i, j):
        h = (seed + 0x27D4EB2F165667C5 + 4) % 2**64
        h ^= v * 0x9E3779B185EBCA87 % 2**64
        h = (((h << 23) | (h >> 41)) % 2**64 * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64
        h ^= h >> 33
        h = h * 0xC2B2AE3D27D4EB4F % 2**64
        h ^= h >> 29
        h = h * 0x165667B19E3779F9 % 2**64
        seed = h ^ (h >> 32)
    return signed(seed)


def test_signatures_against_a_plain_minhash(docs, odd):
    for df in (docs, odd.where("doc_id is not null")):
        want = {r["doc_id"]: "".join(f"{x:02x}" for x in signature(r["text"])) for r in df.collect()}
        assert {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(df).collect()} == want


def test_likeness_is_corrected_for_chance(spark):
    a, b = signature("some words of a text that is not like the other one at all"), signature("entirely different content in this line without a single common word")
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    c = 2**-minhash.STORED_BITS
    assert abs(df.select(minhash.likeness("a", "b")).first()[0] - max(0, (same - c) / (1 - c))) < 1e-12


def test_many_buckets_clashing_columns_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TASK_ROWS", 20)
    rng = random.Random(3)
    rows = [(rng.choice([i, i**3, -i * 7]), " ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randrange(0, 30))), "x", 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string, b int").dropDuplicates(["doc_id"])
    check(df, 1.0)
    long = " ".join(f"w{i % 977}" for i in range(900_000))
    check(spark.createDataFrame([(1, long, 2), (2, long + " x", 3), (3, "", 4)], "doc_id long, text string, ghost int"), 0.25)
