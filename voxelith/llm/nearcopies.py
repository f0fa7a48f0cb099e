"""Near copies: the SimHash operator on five-word shingles, at a similarity of 0.8.

A text's fingerprint has 256 bits, of its set of shingles; the similarity of two texts is the share of
bits that agree, which grows with the cosine of their sets (0.8 of the bits: a cosine of 0.81).  Texts
are linked from 0.8 on, if their sets' sizes differ by a factor of at most 1 / 0.64, as they must for
such a cosine.  (`simhash`, with 64 bits, three words and 2 bits, is another contract's.)

Texts of one shingle set are one class; classes, not documents, are compared, tile by tile with
exclusive-or and bit counts.  A class's cell is its set's size on a logarithmic scale, a cell meets
itself and the next, and tile pairs whose population counts differ beyond the radius are skipped;
both lose nothing.  A tile pair gives a spanning forest of its links: a group of copies costs a row a
member and tile pair, not all its pairs, and what is connected stays so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import discard, fewer_bytes, hot_join, materialize
from .components import components
from .simhash import _BREAKS

SHINGLE = 5
SIMILARITY = 0.8
#: Words of 64 bits in a fingerprint.
WORDS = 4
#: Classes in a tile, about, and tiles of a cell that meet another cell's in one task.
TILE, TILES = 2048, 32
_CHUNK = 65536


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) values of the text's shingles, sorted, each once; the whole word sequence
    of a text of fewer words; none of a text without words."""
    ws = [w for w in (text or "").translate(_BREAKS).encode("utf-8", "surrogatepass").split(b" ") if w]
    if not ws:
        return np.empty(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(ws) < size:
        return np.array([digest(join(ws), 42)], np.uint64)
    return np.unique(np.fromiter((digest(join(t), 42) for t in zip(*(ws[i:] for i in range(size)), strict=False)), np.uint64, len(ws) - size + 1))


def mixed(held: np.ndarray, k: int) -> np.ndarray:
    """The numbers of a set mixed anew for word k of its fingerprint; as they are for the first."""
    if not k:
        return held
    h = held + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(held: np.ndarray) -> int:
    """The bits set in over half of the numbers, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(held), _CHUNK):
        ones += np.unpackbits(held[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(held)).tobytes(), "big", signed=True)


def node(held: np.ndarray) -> int:
    """A number for a set of shingles."""
    return int.from_bytes(xxhash.xxh64_digest(held.tobytes(), 42), "big", signed=True)


def text_key(text: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def forest(one: dict[str, np.ndarray], two: dict[str, np.ndarray], same: bool, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between nodes of two tiles that connect what the tiles' links connect.  A tile has
    `node`, `size` and the words `w0`, `w1`, ..., unsigned: of a negative number numpy counts the bits of
    the absolute value."""
    n, words = len(one["node"]), [k for k in one if k[0] == "w"]
    nodes = one["node"] if same else np.concatenate([one["node"], two["node"]])
    up = np.arange(len(nodes))
    rows = max(1, 1_000_000 // len(two["node"]))
    for at in range(0, n, rows):
        # Half of the words leave few pairs; the rest is counted of those.
        far = sum(np.bitwise_count(one[w][at : at + rows, None] ^ two[w][None, :]).astype(np.uint16) for w in words[: len(words) // 2])
        x, y = np.nonzero(far <= radius)
        far = far[x, y].astype(np.int16)
        x += at
        for w in words[len(words) // 2 :]:
            far += np.bitwise_count(one[w][x] ^ two[w][y])
        a, b = one["size"][x], two["size"][y]
        hit = (far <= radius) & (np.minimum(a, b) >= ratio * np.maximum(a, b))
        x, y = x[hit], y[hit] if same else y[hit] + n
        while len(x):
            i, j = up[x], up[y]
            apart = i != j
            x, y, i, j = x[apart], y[apart], i[apart], j[apart]
            np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
            while (up[up] != up).any():
                up = up[up]
    below = np.nonzero(up != np.arange(len(up)))[0]
    return nodes[below], nodes[up[below]]


def _of(numbers: dict[int, int], key: F.Column) -> F.Column:
    pairs = [F.lit(x) for k, n in numbers.items() for x in (k, n)]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(0)) if pairs else F.lit(0)


def _links(classes: DataFrame, similarity: float, tile: int, words: int) -> DataFrame:
    """classes(node, size, w0, ...) -> (a, b): edges that connect what links connect."""
    ratio, radius = similarity**2, math.floor(64 * words * (1 - similarity) + 1e-9)
    names = [f"w{k}" for k in range(words)]
    placed = classes.where("size > 0").withColumn("cell", F.floor(F.log("size") / -math.log(ratio)).cast("int"))
    # Cells, and so rows for the driver, are as many as the logarithm of the largest size.
    sizes = {r["cell"]: -(-r["n"] // tile) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    pops = sum((F.bit_count(w) for w in names[1:]), F.bit_count(names[0]))
    dealt = placed.withColumn("t", F.pmod(F.xxhash64("node"), _of(sizes, F.col("cell")))).withColumn("p", pops)
    c = F.collect_list(F.struct("node", "size", *names)).alias("c")
    tiles = materialize(dealt.groupBy("cell", "t").agg(F.min("p").alias("low"), F.max("p").alias("high"), c), "tiles")
    # A group of tiles meets the later groups of its cell and all of the next cell; each meeting is a key.
    groups = {k: -(-n // TILES) for k, n in sizes.items()}
    g = F.floor(F.col("t") / TILES).cast("int")

    def spread(cell: F.Column, start: F.Column, stop: F.Column) -> F.Column:
        some = F.transform(F.sequence(start, stop), lambda h: F.struct(cell.alias("cell"), h.alias("g")))
        return F.when(stop >= start, some).otherwise(F.array().cast("array<struct<cell:int,g:int>>"))

    here, zero = F.col("cell"), F.lit(0)
    there = F.concat(spread(here, g, _of(groups, here) - 1), spread(here + 1, zero, _of(groups, here + 1) - 1))
    back = F.concat(spread(here, zero, g), spread(here - 1, zero, _of(groups, here - 1) - 1))
    own = F.struct("cell", g.alias("g"))
    left = tiles.select(own.alias("k1"), F.explode(there).alias("k2"), F.col("t").alias("t1"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.col("c").alias("c1"))
    right = tiles.select(F.explode(back).alias("k1"), own.alias("k2"), F.col("t").alias("t2"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("c").alias("c2"))
    both = left.join(right, ["k1", "k2"]).where((F.col("k1") != F.col("k2")) | (F.col("t1") <= F.col("t2")))
    both = both.where(f"l1 - h2 <= {radius} and l2 - h1 <= {radius}")
    both = both.select("c1", "c2", ((F.col("k1") == F.col("k2")) & (F.col("t1") == F.col("t2"))).alias("same"))

    def arrays(column: pa.Array, i: int) -> dict[str, np.ndarray]:
        held = column[i].values
        out = {f.name: held.field(f.name).to_numpy(zero_copy_only=False) for f in held.type}
        return out | {w: out[w].view(np.uint64) for w in names}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = forest(arrays(batch.column(0), i), arrays(batch.column(1), i), batch.column(2)[i].as_py(), radius, ratio)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    with fewer_bytes(classes.sparkSession):
        out = materialize(both.mapInArrow(compare, "a long, b long"), "links")
    discard(tiles)
    return out


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, tile: int = TILE, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, key, group), a row for each row of docs.

    key is a hash of the text.  Rows are of one group if links of at least `similarity` connect them; a
    text of fewer than `size` words is one shingle, and all texts without words (null: without words)
    are one class.  Repeated rows stay, an empty table gives an empty table, and other columns are
    ignored, whatever their names."""
    names = [f"w{k}" for k in range(words)]

    @pandas_udf("node long, size long, " + ", ".join(f"{w} long" for w in names))
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                x = shingles(t, size)
                rows.append((node(x), len(x), *(majority(mixed(x, k)) for k in range(words))))
            yield pd.DataFrame(rows, columns=["node", "size", *names], dtype="int64")

    own = docs.select("doc_id", text_key().alias("key"), sketch(F.col("text").cast("string")).alias("s")).select("doc_id", "key", "s.*")
    with fewer_bytes(docs.sparkSession):
        own = materialize(own, "sketches")
    classes = own.groupBy("node").agg(F.first("size").alias("size"), *[F.first(w).alias(w) for w in names], F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    links = _links(classes, similarity, tile, words)
    final = classes.select("node", "n").join(components(links), "node", "left").select("node", "n", F.coalesce("root", "node").alias("group"))
    final = materialize(final, "groups")
    discard(classes, links)
    total = final.agg(F.sum("n")).first()[0] or 0
    return hot_join(own.select("doc_id", "key", "node"), final, "node", "n", total).select("doc_id", "key", "group")
