"""Quality classifier: supervised subword embeddings.

A document's features are its words, pairs of neighbouring words and character n-grams, hashed into
a table of learned vectors; their mean goes through a linear layer and softmax.  Vectors and layer
are trained by stochastic gradient descent in numpy.  Since mean and layer are linear, a feature's
vector counts for a score only through one number, so scoring reads a table of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Labelled documents that are learned from at most, those whose ids have the smallest hashes, and the
#: characters of one at most: longer ones are not learned from.  So 800 MB of text reach the driver at
#: the very most; all texts are scored whole.
TRAIN_ROWS, TRAIN_CHARS = 4000, 200_000
TABLE_BITS = 18
DIM = 8
NGRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 1.0
SEED = 5
_P = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = TABLE_BITS, grams: tuple[int, ...] = NGRAMS) -> np.ndarray:
    """The table places of a text's features, repeats included; none for a text without words.

    White space is one space, and one stands before and after the text; n-grams are of characters
    within a word with the spaces at its ends."""
    joined = " ".join((text or "").split())
    if not joined:
        return np.zeros(0, np.int64)
    cp = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = np.nonzero(cp == 32)[0]
    # A word's hash: the sum of its characters times powers of an odd number, by place in the word.
    place = np.arange(len(cp)) - np.repeat(space, np.diff(np.append(space, len(cp))))
    power = _powers(int(place.max()) + 1)
    sums = np.add.reduceat(cp * power[place], space)[:-1]
    out = [_mix(sums, bits), _mix(sums[:-1] * np.uint64(31) + sums[1:] + np.uint64(7), bits)]
    breaks = np.cumsum(cp == 32)
    for n in grams:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * _P + cp[k : len(cp) - n + 1 + k]
        # No space but at the ends.
        inner = breaks[n - 2 : len(cp) - 1] - breaks[: len(cp) - n + 1] == 0
        out.append(_mix(h[inner], bits))
    return np.concatenate(out)


@dataclass
class Model:
    """score = sigmoid(bias + mean of numbers at a text's features)"""

    numbers: np.ndarray
    bias: float
    bits: int = TABLE_BITS

    def score(self, text: str | None) -> float:
        at = features(text, self.bits)
        x = self.bias + (float(self.numbers[at].mean()) if len(at) else 0.0)
        return 1.0 / (1.0 + np.exp(-x)) if x > -700 else 0.0


def train(
    texts: list[str | None], labels: list[int], bits: int = TABLE_BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED
) -> Model:
    """Fit vectors and layer by stochastic gradient descent, a document a step, over `epochs`
    shuffled passes with a falling rate.

    Without labels of both kinds the layer stays at zero but for the bias, which gives the share of
    label 1."""
    y = np.array(labels, np.float64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(2**bits, np.float32), start, bits)
    rng = np.random.default_rng(seed)
    table = ((rng.random((2**bits, dim), np.float32) - 0.5) / dim).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    base = np.array([0.0, start], np.float32)
    seen = []
    for t in texts:
        at, n = np.unique(features(t, bits), return_counts=True)
        seen.append((at, (n / max(1, n.sum())).astype(np.float32)))
    step, steps = 0, epochs * len(seen)
    for _ in range(epochs):
        for i in rng.permutation(len(seen)):
            at, weight = seen[i]
            now = rate * (1 - step / steps)
            step += 1
            rows = table[at]
            mean = weight @ rows
            z = mean @ layer + base
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1.0
            back = layer @ p
            layer -= now * np.outer(mean, p)
            base -= now * 0.1 * p
            # Each vector moves by the whole gradient of the mean, as frequent ones occur in it more.
            table[at] = rows - now * np.minimum(1.0, weight * len(at))[:, None] * back[None, :]
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(base[1] - base[0]), bits)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the third of the ids that labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **limits: float) -> Model:
    """Learn labels.quality from at most train_rows documents that are not held out.

    They are those with the smallest hashed ids, so the choice depends on ids alone; of them, texts of
    over TRAIN_CHARS characters are left out, as are labels other than 0 and 1, and ids that are null.
    Of an id's texts, if it is repeated, the least is learned from; a null text has no features.  Only
    doc_id and text of docs, doc_id and quality of labels are read, whatever else they have.  Empty
    tables give a model that scores all texts alike."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    if not some.take(1):
        return train([], [])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(f"text is null or length(text) <= {TRAIN_CHARS}").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in got], [r["quality"] for r in got], **limits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    score is the probability of label 1; a null or wordless text has that of the bias alone.  Only
    the text is scored; repeated rows stay, an empty table gives an empty table, and other columns are
    ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for s in texts:
            yield pd.Series([own.score(t) for t in s], dtype="float64")

    out = docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
