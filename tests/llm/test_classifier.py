import zlib

import numpy as np

from voxelith.llm import classifier


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    got = classifier.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    right = [r["predicted"] == r["quality"] for r in got]
    assert np.mean(right) > 0.95
    assert np.mean([x for x, r in zip(right, got, strict=True) if r["quality"]]) > 0.97


def test_numpy_replay():
    """Training and scoring, feature by feature in plain Python."""
    texts, labels = ["good words of a text", "bad bad bad", "more good words", "bad # # text", ""], [1, 0, 1, 0, 1]
    bits, dim, epochs, rate = 6, 3, 4, 0.7
    rng = np.random.default_rng(classifier.SEED)
    table = ((rng.random((2**bits, dim), np.float32) - 0.5) / dim).astype(float)
    layer, base = np.zeros((dim, 2)), np.array([0.0, np.log(0.6 / 0.4)])
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at = classifier.features(texts[i], bits).tolist()
            now = rate * (1 - step / (epochs * len(texts)))
            step += 1
            mean = np.zeros(dim)
            for k in at:
                mean += table[k] / len(at)
            e = np.exp(mean @ layer + base)
            p = e / e.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer = layer - now * np.outer(mean, p)
            base = base - now * 0.1 * p
            kinds = sorted(set(at))
            for k in kinds:
                table[k] -= now * min(1.0, at.count(k) / len(at) * len(kinds)) * back
    model = classifier.train(texts, labels, bits, dim, epochs, rate)
    for t in [*texts, "good text", "unseen"]:
        at = classifier.features(t, bits)
        mean = table[at].mean(axis=0) if len(at) else np.zeros(dim)
        z = mean @ layer + base
        assert abs(model.score(t) - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-5


def test_features_are_words_pairs_and_ngrams():
    def mix(h):
        h &= 2**64 - 1
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - 18)

    odd = 0x9E3779B97F4A7C15
    words = ["ab", "cde", "ab"]
    sums = [sum(ord(c) * odd**k for k, c in enumerate(" " + w)) % 2**64 for w in words]
    want = [mix(h) for h in sums] + [mix(a * 31 + b + 7) for a, b in zip(sums, sums[1:])]
    for n in classifier.NGRAMS:
        for w in words:
            own = f" {w} "
            for i in range(len(own) - n + 1):
                h = n
                for c in own[i : i + n]:
                    h = (h * odd + ord(c)) % 2**64
                want.append(mix(h))
    assert sorted(classifier.features(" ab\tcde\n ab ").tolist()) == sorted(want)


def test_clashing_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "good words here", 1, 0.5), (2, "bad # # #", 0, 0.1), (3, "long words " * 450_000, 1, 0.0), (3, None, 1, 0.0)], "doc_id long, text string, quality int, score double")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 4)], "doc_id long, quality int, text string")
    out = classifier.score(docs, classifier.fit(docs, labels))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 4
    assert classifier.score(docs.limit(0), classifier.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (6, 0), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    model = classifier.fit(odd, labels)
    out = classifier.score(odd, model)
    assert out.count() == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())
    assert classifier.score(empty, classifier.fit(empty, labels.limit(0))).count() == 0


def test_features_of_words_do_not_leak_over_spaces():
    a = set(classifier.features("abc def").tolist())
    b = set(classifier.features("abc").tolist()) | set(classifier.features("def").tolist())
    assert b <= a and len(a) <= len(b) + 1
