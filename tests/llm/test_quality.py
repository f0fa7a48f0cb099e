import random
import re
from collections import Counter

from voxelith.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(places) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(places), failed


def check(df):
    for r in quality.quality_report(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_measures(docs):
    check(docs)


def test_odd_rows(odd, empty):
    check(odd)
    assert quality.quality_report(odd).count() == odd.count()
    assert quality.quality_report(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_verdicts(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.quality_report(docs).join(labels, "doc_id").where("n_words >= 50").collect()
    assert all(r["kept"] for r in got if r["quality"] == 1 and not r["base_failed"])
    assert not any(r["kept"] for r in got if r["quality"] == 0)


def test_rank_is_by_rejections_among_what_is_left():
    # The second rule rejects most, but nearly all of that the first one does too, for less.
    rows = [(True, True, False)] * 50 + [(False, True, False)] * 5 + [(False, False, True)] * 20 + [(False, False, False)] * 25
    assert quality.by_rank(rows, [1.0, 2.0, 1.0]) == [0, 2, 1]
    assert quality.by_rank(rows, [1.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.by_rank([], [3.0, 1.0, 2.0]) == [1, 2, 0]
    assert quality.by_rank(rows, [1.0, 2.0, 1000.0]) == [0, 1, 2]


def test_cheap_rules_come_before_costly_ones(docs):
    names = [r.name for r in quality.ordered(docs)]
    assert sorted(names) == sorted(r.name for r in quality.RULES)
    assert names.index("few_words") < names.index("repeated_windows")


def test_order_does_not_change_the_verdict(docs):
    back = tuple(reversed(quality.RULES))
    a = {r["doc_id"] for r in quality.quality_rules(docs).collect()}
    b = {r["doc_id"] for r in docs.where(~quality.F.col("doc_id").isin(-1)).transform(lambda d: quality.quality_rules(d, back)).collect()}
    assert a == b == {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}


def test_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.random()}"]) for _ in range(500_000))
    check(spark.createDataFrame([(1, long), (2, "x" * 5_000_000)], "doc_id long, text string"))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 30, 5, "x")], "doc_id long, text string, n_words int, _text string")
    assert quality.quality_rules(df, quality.RULES[:2]).collect() == df.collect()
    assert quality.quality_report(df).first()["n_words"] == 60
