"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A fingerprint's bit is 1 if it is set in over half of the XXH64 (seed 42) values of the text's
three-word shingles, repeats included.  Equal fingerprints are one class; classes, not documents,
are compared, so thousands of copies cost one row.

Classes are sorted into cells by the population counts of the fingerprint's parts.  Two fingerprints
within r bits have cells within r of each other (sum of absolute differences), so a tile meets only
tiles of such cells; all other tile pairs are skipped, which loses nothing.  The number of parts
follows the number of classes, so that cells stay small as it grows.  A cell's classes are cut into
tiles of bounded size, and a tile pair is compared with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

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

#: Fingerprints in a tile, about; a tile pair needs eight times its square in bytes for a block of rows.
TILE = 2048
_BREAKS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
_CHUNK = 65536


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    ws = [w for w in (text or "").translate(_BREAKS).encode("utf-8", "surrogatepass").split(b" ") if w]
    if not ws:
        return 0
    digest = xxhash.xxh64_digest
    if len(ws) < size:
        hashes = [digest(b" ".join(ws), 42)]
    else:
        join = b" ".join
        hashes = [digest(join(t), 42) for t in zip(*(ws[i:] for i in range(size)), strict=False)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        block = np.frombuffer(b"".join(hashes[i : i + _CHUNK]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp long), a row for each row of docs."""

    @pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t, size) for t in s], dtype="int64")

    return docs.select("doc_id", fp("text").alias("fp"))


def _near_cells(radius: int, parts: int) -> list[int]:
    """Offsets of cell numbers (a digit for each part) up to radius apart; of each offset and its
    negative only one."""
    found = {0}
    for _ in range(radius):
        found |= {s + d * _base(radius, parts) ** i for s in found for i in range(parts) for d in (1, -1)}
    return sorted(x for x in found if x >= 0)


def _base(radius: int, parts: int) -> int:
    """A digit holds a part's population count and differences of up to radius without a carry."""
    return 64 // parts + 2 * radius + 2


def _cell(fp: F.Column, radius: int, parts: int) -> F.Column:
    width = 64 // parts
    counts = [F.bit_count(F.shiftright(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(parts)]
    return sum((c * F.lit(_base(radius, parts) ** i) for i, c in enumerate(counts[1:], 1)), counts[0])


def parts_for(classes: int, radius: int) -> int:
    """4, 8 or 16 parts: those for which comparisons, and rows sent to other cells, cost least.

    Independent bits spread a part's count like a binomial, so a share of 1 / (2 sqrt(pi v)) of pairs
    agrees in a part of variance v.  A row sent counts as a thousand comparisons."""
    def cost(parts: int) -> float:
        cells = (2 * (3.14159 * 16 / parts) ** 0.5) ** parts
        near = 1.0
        for k in range(1, radius + 1):
            near *= 2 * parts / k
        return near * (classes / cells + 1000)

    return min((n for n in (4, 8, 16) if _base(radius, n) ** n < 2**62), key=cost)


def near_pairs(classes: DataFrame, radius: int = 2, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """classes(fp) of distinct fingerprints -> (a, b), every pair at most radius bits apart."""
    parts = parts or parts_for(classes.count(), radius)
    cells = classes.select("fp", _cell(F.col("fp"), radius, parts).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    split = sizes.where(F.col("n") > tile).select("cell", F.ceil(F.col("n") / tile).cast("long").alias("tiles"))
    # Only a cell of over `tile` classes is split; its rows are dealt by their own hash.
    dealt = cells.join(split, "cell", "left").select(
        "fp", "cell", F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), "tiles")).cast("long").alias("tile")
    )
    tiles = materialize(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = F.array(*[F.lit(x) for x in _near_cells(radius, parts)])
    left = tiles.select(
        F.col("cell").alias("c1"), F.col("tile").alias("t1"), F.col("fps").alias("f1"), F.explode(F.transform(near, lambda d: F.col("cell") + d)).alias("cell")
    )
    right = tiles.select("cell", F.col("tile").alias("t2"), F.col("fps").alias("f2"))
    pairs = left.join(right, "cell").where((F.col("c1") != F.col("cell")) | (F.col("t1") <= F.col("t2")))
    pairs = pairs.select("f1", "f2", ((F.col("c1") == F.col("cell")) & (F.col("t1") == F.col("t2"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            a_out, b_out = [], []
            for i in range(batch.num_rows):
                # Unsigned: of a negative number numpy counts the bits of the absolute value.
                a = one[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = two[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows = max(1, 2_000_000 // len(b))
                for at in range(0, len(a), rows):
                    hit = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
                    x, y = np.nonzero(hit)
                    if same[i]:
                        keep = x + at < y
                        x, y = x[keep], y[keep]
                    if len(x):
                        a_out.append(a[x + at].view(np.int64))
                        b_out.append(b[y].view(np.int64))
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, tile: int = TILE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest doc_id that links of at most radius bits reach.  A null or
    wordless text has fingerprint 0, which links like any other.  A row whose doc_id is null
    keeps its fingerprint and takes part in its class; the class's id is then the smallest that
    is not null (null if there is none).  Repeated rows stay repeated.  An empty table gives an
    empty table.  Other columns of docs are ignored, whatever their names."""
    with fewer_bytes(docs.sparkSession):
        own = materialize(fingerprints(docs, size), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    with fewer_bytes(docs.sparkSession):
        links = materialize(near_pairs(classes.select("fp"), radius, tile), "links")
    roots = components(links)
    # The smallest doc_id of each component of fingerprints.
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = linked.join(least, "root").select("fp", "component_id")
    final = classes.join(known, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    final = materialize(final, "components")
    discard(links)
    # A fingerprint that many documents share is no task of its own.
    total = final.agg(F.sum("n")).first()[0] or 0
    return hot_join(own, final, "fp", "n", total).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
