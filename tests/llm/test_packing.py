import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from voxelith.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def want(rows, tok, cap):
    out = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(d, k, i, len(ids[i : i + cap]), zlib.crc32(np.array(ids[i : i + cap], "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), cap))]
    return sorted(out, key=str)


def check(df, tok, cap):
    got = packing.pack(df, PATH, cap).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == want([(r["doc_id"], r["text"]) for r in df.collect()], tok, cap)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= cap
    return len(held), sum(r["length"] for r in got) / cap


@pytest.mark.parametrize("cap", [4096, 100])
def test_pack(docs, odd, empty, tok, cap):
    n, least = check(docs, tok, cap)
    assert n <= least * 1.05 + 1
    check(odd, tok, cap)
    assert packing.pack(empty, PATH).count() == 0


def best_fit_decreasing(lengths, cap):
    bins = []
    for x in sorted(map(int, lengths), reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= x), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(cap - x)
        else:
            bins[fit] -= x
    return len(bins)


@pytest.fixture
def many_ranges(spark):
    """Small tables too are dealt to all ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_supersteps_pack_as_well_as_best_fit_decreasing(spark, many_ranges):
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 101, 3000), rng.integers(30, 60, 999), np.full(77, 51), np.array([100]), np.ones(7, int), rng.integers(1, 9, 2000)):
        items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, length long").repartition(4)
        got = packing.best_fit(items, 100).collect()
        assert sorted((r["id"], r["length"]) for r in got) == list(enumerate(map(int, lengths)))
        held = {}
        for r in got:
            held[r["seq"]] = held.get(r["seq"], 0) + r["length"]
        assert max(held.values()) <= 100
        assert len(held) <= 1.03 * best_fit_decreasing(lengths, 100) + 2


def sweep(items):
    """A stack in place of numbers: upwards, a gap takes the latest pieces."""
    stack, out = [], {}
    for size, kind, i, w in sorted(items):
        if kind == 0:
            stack.append(i)
        else:
            for _ in range(min(-w, len(stack))):
                out[stack.pop()] = i
    return out


def test_a_sweep_is_that_of_a_stack(spark, many_ranges):
    rng = np.random.default_rng(2)
    for n, m in ((400, 300), (50, 400), (400, 20), (1, 1)):
        rest = [(i, int(x)) for i, x in enumerate(rng.integers(5, 21, n))]
        gaps = [(1000 + i, int(x)) for i, x in enumerate(rng.integers(1, 70, m))]
        short, long = min(x for _, x in rest), max(x for _, x in rest)
        a = spark.createDataFrame(rest, "id long, length long").repartition(5)
        b = spark.createDataFrame(gaps, "seq long, gap long").repartition(5)
        items = [(x, 0, i, 1) for i, x in rest] + [(g, 1, s, -max(1, g // long)) for s, g in gaps if g >= short]
        got = {r["id"]: r["seq"] for r in packing.match(a, b, short, long).collect() if r["seq"] is not None}
        assert got == sweep(items)
        frame = spark.createDataFrame(items, "size long, kind int, id long, w long").repartition(5)
        parts = {r["part"] for r in packing.swept(frame).select("part").distinct().collect()}
        assert len(parts) > 3 or len(items) < 10


def test_ranges_need_two_numbers_of_each_other():
    assert packing.left_over([(0, 3, 0), (1, -5, -5), (2, 4, -1), (3, -2, -2)]) == [(0, 0), (1, 3), (2, 0), (3, 5)]


def test_tokenizer_is_the_tokenizer(rows, tok):
    mine = packing.word_tokenizer(PATH)
    odd = ["it's 42nd don't I'LL", "ΑΣ ß", "a\x1cb c\x85d\xa0e", "naïve ÀÉ ÿ Ÿ 10³ x² ½", "é É", "<|endoftext|> x <|", "...!!! a,b;c", "\x7f\x00"]
    for t in [*rows.values(), *odd]:
        assert np.frombuffer(mine(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_long_texts_and_clashing_columns(spark, tok):
    long = " ".join(f"word{i % 1013}" for i in range(640_000))
    assert len(long) > 4_500_000
    df = spark.createDataFrame([(1, long, 7, "x"), (2, None, None, None), (3, "a b", 1, "y"), (3, "a b", 1, "y")], "doc_id long, text string, length int, sequence_id string")
    n, least = check(df, tok, 4096)
    assert n <= least + 2
