"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

A text's five-word shingles (the whole word sequence, if shorter) are hashed once.  The top bits of
a hash name its bin, and a bin keeps its smallest hash.  An empty bin is filled by optimal
densification: it takes the value of the first full bin in a pseudo-random order of bins that
depends on the empty bin alone.  Of each bin the low-order bits are stored, packed as hexadecimal
digits.  The share m of equal stored values estimates likeness as (m - c) / (1 - c), where
c = 2^-bits is the share that would be equal by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, words

SHINGLE = 5
#: 2^BIN_BITS bins of STORED_BITS bits each.
BIN_BITS = 7
STORED_BITS = 8
#: Orders of bins tried one by one before the rest of an order is searched at once.
PROBES = 6


def _shingle_hashes(w: str, size: int) -> str:
    parts = ", ".join(f"{w}[i + {k}]" for k in range(size))
    return f"case when size({w}) < {size} then array(xxhash64(array_join({w}, ' '))) else transform(sequence(0, size({w}) - {size}), i -> xxhash64({parts})) end"


def _bins(hashes: str, bin_bits: int) -> str:
    """Array of the smallest hash of each bin, null for an empty bin.  Each bin's largest possible
    value is added as a mark, so that after sorting each bin begins with its smallest hash."""
    n, low = 2**bin_bits, 64 - bin_bits
    first = -(2 ** (bin_bits - 1))
    mark = (1 << low) - 1
    marks = f"transform(sequence({first}, {first + n - 1}), b -> shiftleft(cast(b as bigint), {low}) + {mark}L)"
    return f"""element_at(transform(array(sort_array(concat({hashes}, {marks}))), s ->
      transform(
        filter(zip_with(s, concat(array(cast(null as bigint)), slice(s, 1, size(s) - 1)), (x, p) ->
          case when p is null or shiftright(x, {low}) <> shiftright(p, {low}) then x end), x -> x is not null),
        x -> case when (x & {mark}L) = {mark}L then null else x & {mark}L end)), 1)"""


def _orders(bin_bits: int, probes: int) -> list[str]:
    """probes tables from a fixed seed: the t-th bin that each empty bin tries, from 1."""
    n, draw = 2**bin_bits, random.Random(11)
    return [f"cast(split('{','.join(str(draw.randrange(n) + 1) for _ in range(n))}', ',') as array<int>)" for _ in range(probes)]


def _filled(v: str, bin_bits: int, stored: int, probes: int = PROBES) -> str:
    """Array of the stored bits of each bin, empty bins filled."""
    n, mask = 2**bin_bits, 2**stored - 1
    tries = ", ".join(f"{v}[element_at({t}, i + 1) - 1]" for t in _orders(bin_bits, probes))
    rest = f"""array_min(filter(transform({v}, (y, j) -> case when y is not null then struct(xxhash64(i, j) as r, y as y) end), y -> y is not null)).y"""
    return f"transform({v}, (x, i) -> cast((case when x is not null then x else coalesce({tries}, {rest}) end) & {mask}L as int))"


def with_signature(df: DataFrame, text: str, out: str, bin_bits: int = BIN_BITS, stored: int = STORED_BITS, size: int = SHINGLE) -> DataFrame:
    """df with the column `out`: array<int> of the stored bits of each bin of df's column `text`.

    A null or wordless text is the one shingle of no words.  Equal word sequences have equal
    signatures.  Steps are columns of their own, so that none is evaluated twice."""
    keep = [c for c in df.columns if c != out]
    df = df.select(*keep, words(F.col(text)).alias(f"_w_{out}"))
    df = df.select(*keep, F.expr(_bins(_shingle_hashes(f"_w_{out}", size), bin_bits)).alias(f"_v_{out}"))
    return df.select(*keep, F.expr(_filled(f"_v_{out}", bin_bits, stored)).alias(out))


def packed(sig: str, stored: int = STORED_BITS) -> Column:
    """Hexadecimal digits of a signature's stored bits (a whole number of digits a bin)."""
    return F.expr(f"lower(array_join(transform({sig}, x -> lpad(hex(x), {stored // 4}, '0')), ''))")


def likeness(a: str, b: str, stored: int = STORED_BITS) -> Column:
    """Estimated share of common shingles of two signatures, 0 to 1, corrected for chance."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), x -> x)) / size({a})"
    c = 2.0**-stored
    return F.expr(f"least(1D, greatest(0D, (cast({same} as double) - {c}D) / (1D - {c}D)))")


def fingerprints(docs: DataFrame, bin_bits: int = BIN_BITS, stored: int = STORED_BITS, size: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint), a row for each row of docs; a null text
    counts as empty, repeated rows stay, an empty table gives an empty table."""
    out = with_signature(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "sig", bin_bits, stored, size)
    return out.select("doc_id", packed("sig", stored).alias("fingerprint"))


#: Rows in a task, about, and the most buckets: their bounds, a number each, come to the driver.
TASK_ROWS, MOST_BUCKETS = 20_000, 65_536


def _buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """docs with _bucket, a range of doc_id; the first doc_id of each bucket that has rows; and the
    tasks to deal buckets to, two buckets each, whose number follows that of the rows.

    The bounds are approximate quantiles, so the ranges hold about equally many rows whatever the
    ids are; they come to the driver, MOST_BUCKETS at most.  Null ids go first."""
    tasks = max(partitions(docs.sparkSession), min(docs.count() // TASK_ROWS, MOST_BUCKETS // 2))
    n = 2 * tasks
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    step = max(1, round(len(cuts) ** 0.5))
    coarse = cuts[::step]
    lit = lambda xs: f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)"
    if cuts:
        block = f"size(filter({lit(coarse)}, b -> b <= doc_id))"
        docs = docs.withColumn("_block", F.expr(f"case when doc_id is null then 0 else {block} end"))
        inner = f"size(filter(slice({lit(cuts)}, (_block - 1) * {step} + 1, {step}), b -> b <= doc_id))"
        docs = docs.withColumn("_bucket", F.expr(f"case when _block = 0 then 0 else (_block - 1) * {step} + {inner} end")).drop("_block")
    else:
        docs = docs.withColumn("_bucket", F.lit(0))
    return docs, docs.groupBy("_bucket").agg(F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_nulls")), tasks


def edited_pairs(docs: DataFrame, bin_bits: int = BIN_BITS, stored: int = STORED_BITS, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they are to each other and to
    the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending doc_id; the first follows the last.  Null ids go first;
    equal ids are ordered by text.  A null text counts as empty.  Rows meet their neighbours in
    ranges of ids: a copy of each range's first rows goes to the range before, so no range needs
    another, and no task sorts the whole table.  Repeated rows follow each other; an empty table
    gives an empty table; other columns are ignored, whatever their names."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed, firsts, tasks = _buckets(own)
    edges = sorted(firsts.collect(), key=lambda r: r["_bucket"])  # a row a bucket
    links = {r["_bucket"]: (None if r["_nulls"] else r["_first"], edges[i - 1]["_bucket"]) for i, r in enumerate(edges)}
    # As many rows as there are buckets.
    table = F.broadcast(docs.sparkSession.createDataFrame([(b, first, before) for b, (first, before) in links.items()] or [(0, None, 0)], "_bucket int, _first long, _before int"))
    placed = placed.join(table, "_bucket").withColumn(
        "_at", F.expr("case when doc_id <=> _first then array(struct(_bucket as b, false as ghost), struct(_before as b, true as ghost)) else array(struct(_bucket as b, false as ghost)) end")
    )
    placed = placed.select("doc_id", "text", F.explode("_at").alias("_at")).select("doc_id", "text", "_at.b", "_at.ghost")
    if tasks > partitions(docs.sparkSession):
        placed = placed.repartition(tasks, "b")
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    near = placed.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    near = near.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), coalesce(substring(next, 1, cast(n_chars div 4 as int)), ''))"))
    near = near.select("doc_id", "b", "ghost", "text", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    near = with_signature(near, "text", "sig", bin_bits, stored, size)
    near = with_signature(near, "edited", "edited_sig", bin_bits, stored, size)
    near = near.withColumn("next_sig", F.lead("sig").over(order)).where("not ghost")
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed("sig", stored).alias("fingerprint"),
        packed("edited_sig", stored).alias("edited_fingerprint"),
        likeness("sig", "edited_sig", stored).alias("near_edited"),
        likeness("sig", "next_sig", stored).alias("near_next"),
    )
