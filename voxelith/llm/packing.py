"""Best-fit packing of token sequences, bulk-synchronously.

Documents are tokenised once and cut into pieces; a sequence that is not full is a gap.  Pieces go by
bands of lengths, the longest band first.  A superstep over a band's pieces and the gaps

  1. range-sorts pieces and gaps together by size, pieces first where sizes are equal;
  2. sweeps each range upwards, as if pieces were opening and gaps closing brackets: a gap takes the
     longest piece below it that no smaller gap has taken, so each piece goes to its successor gap.
     Of another range a sweep needs the number of pieces left over alone, two numbers a range;
  3. resolves conflicts by rank: pieces left over below a place are numbered, the gap there takes the
     last numbers, and piece and gap of one number meet in a shuffle by that number.  A gap that holds
     several of the band's longest pieces takes as many at once;
  4. updates the gaps.

Supersteps repeat while any gap holds any of the band's pieces; what then is left of the band opens
new sequences, each range by itself in descending order, and their gaps serve the shorter bands.
Each superstep is written to the shared folder.  The driver holds two numbers a range.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fewer_bytes, materialize

#: Texts of these characters alone are split and lower-cased by Python's re with the same result as
#: by the tokenizer: ASCII without control characters and apostrophe, and the letters U+00DF to
#: U+00FF with their capitals.  All other texts go to the tokenizer whole.
_SIMPLE = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
_PRETOKEN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_MOST_CACHED = 300_000


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Text is cut at white space and into the tokenizer's pre-tokens, whose ids do not depend on
    their neighbours; a word is encoded once while it stays in a bounded cache.  Byte 0xFF, which no UTF-8 text has,
    stands for the end-of-word mark, so that the same merges run as ranks."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = _byte_of()
        end = "</w>"
        ranks = {}
        for token, i in vocab.items():
            last = len(token) > len(end) and token.endswith(end)
            body = bytes(byte_of[c] for c in (token[: -len(end)] if last else token))
            ranks[body + b"\xff" * last] = i
        missing = max(ranks.values()) + 1
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = missing
                missing += 1
        self.bpe = tiktoken.Encoding("word", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cache: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not _SIMPLE.fullmatch(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        cache = self.cache
        parts = text.lower().split()
        if len(cache) > _MOST_CACHED:
            cache.clear()
        piece = self.bpe.encode_single_piece
        for w in set(parts).difference(cache):
            ids = [i for p in _PRETOKEN.findall(w) for i in piece(p.encode() + b"\xff")]
            cache[w] = np.array(ids, "<u4").tobytes()
        return b"".join(map(cache.__getitem__, parts))


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One a Python worker: the cache outlives the task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECES = "id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) -> a row for each piece of at most capacity tokens, with an id of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path)
        ended = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 36
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + ended
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((number, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    number += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high]: halves of the capacity and quarters below them."""
    out, high = [], capacity
    while high:
        low = high // (2 if high > capacity // 4 else 4)
        out.append((low, high))
        high = low
    return out


SWEPT = "size long, kind int, id long, w long, part int, before long, low long"


def swept(items: DataFrame) -> DataFrame:
    """items(size, kind, id, w) range-sorted by size, kind and id, with the range's number (part), the sum
    of w before the row in its range (before), and the least of these sums so far (low)."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, least = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column("w").to_numpy()
            before = total + np.cumsum(w) - w
            low = np.minimum(np.minimum.accumulate(before), least)
            total, least = int(before[-1] + w[-1]), int(low[-1])
            more = [pa.array(np.full(len(w), part, np.int32)), pa.array(before), pa.array(low)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[x.split()[0] for x in SWEPT.split(", ")])

    order = ["size", "kind", "id"]
    return items.select(*order, "w").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT)


def left_over(sums: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """From (part, sum, least prefix sum) of each range the pieces left over below it."""
    out, level = [], 0
    for part, total, least in sorted(sums):
        out.append((part, level))
        level += total - min(0, level + least)
    return out


def match(rest: DataFrame, gaps: DataFrame, shortest: int, longest: int) -> DataFrame:
    """One sweep of rest(id, length) and gaps(seq, gap) -> (id, length, seq): each piece with the
    sequence it goes to, or null.  What is returned is written already."""
    one = rest.select(F.col("length").alias("size"), F.lit(0).alias("kind"), "id", F.lit(1).cast("long").alias("w"))
    two = gaps.where(F.col("gap") >= shortest).select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("seq").alias("id"), F.expr(f"-greatest(1, gap div {longest})").alias("w"))
    items = materialize(swept(one.unionByName(two)), "swept")
    # A row a range, and so a bounded number of rows for the driver and the broadcast.
    sums = items.groupBy("part").agg(F.sum("w").alias("t"), F.min(F.least("before", F.col("before") + F.col("w"))).alias("m")).collect()
    below = rest.sparkSession.createDataFrame(left_over([tuple(r) for r in sums]), "part int, level long")
    at = items.join(F.broadcast(below), "part").withColumn("n", F.expr("level + before - least(0, level + low)"))
    at = at.withColumn("n", F.explode(F.expr("case when kind = 0 then array(n + 1) when n > 0 then transform(sequence(0, least(-w, n) - 1), k -> n - k) else cast(array() as array<bigint>) end")))
    # Pieces and gaps of one number take turns, at most one turn a length.
    order = Window.partitionBy("n").orderBy("size", "kind", "id")
    pairs = at.withColumn("k", F.lead("kind").over(order)).withColumn("seq", F.lead("id").over(order)).where("kind = 0")
    out = materialize(pairs.select("id", F.col("size").alias("length"), F.expr("case when k = 1 then seq end").alias("seq")), "matched")
    discard(items)
    return out


#: New sequences of a range at least, so that its last one, which may stay part empty, is one of many.
RANGE_SEQUENCES = 256


def opened(rest: DataFrame, capacity: int, tokens: int) -> DataFrame:
    """rest(id, length), of so many tokens -> (id, length, seq): new sequences, named by their first
    pieces.  Each range of lengths fills one sequence after the other, the longest pieces first."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, room = -1, 0
        for batch in batches:
            ids, lengths = (batch.column(c).to_numpy() for c in ("id", "length"))
            ends = np.cumsum(lengths)
            seq, at = np.empty(len(ids), np.int64), 0
            while at < len(ids):
                if lengths[at] > room:
                    name, room = ids[at], capacity
                stop = int(np.searchsorted(ends, room + (ends[at] - lengths[at]), "right"))
                seq[at:stop] = name
                room -= int(ends[stop - 1] - ends[at] + lengths[at])
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("length"), pa.array(seq)], names=["id", "length", "seq"])

    order = [F.col("length").desc(), F.col("id")]
    most = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = max(1, min(most, tokens // (capacity * RANGE_SEQUENCES)))
    return rest.select("id", "length").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(fill, "id long, length long, seq long")


def _limits(rest: DataFrame) -> tuple[int, int, int, int]:
    """Rows, least and greatest length, sum of lengths."""
    r = rest.agg(F.count("*"), F.min("length"), F.max("length"), F.sum("length")).first()
    return tuple(v or 0 for v in r)


def best_fit(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """items(id, length) of unique ids and lengths from 1 to capacity -> (id, length, seq)."""
    gaps, done = None, []
    for low, high in bands(capacity):
        rest = items.where(f"length > {low} and length <= {high}").select("id", "length")
        n, shortest, longest, tokens = _limits(rest)
        if not n:
            continue
        if 2 * shortest > capacity:  # each has a sequence of its own
            new = rest.withColumn("seq", F.col("id"))
        else:
            while n and gaps is not None and (gaps.agg(F.max("gap")).first()[0] or 0) >= shortest:
                found = match(rest, gaps, shortest, longest)
                done.append(found.where("seq is not null"))
                used = done[-1].groupBy("seq").agg(F.sum("length").alias("used"))
                less = materialize(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
                discard(gaps)
                gaps, rest = less, found.where("seq is null").drop("seq")
                n, shortest, longest, tokens = _limits(rest)
            if not n:
                continue
            new = materialize(opened(rest, capacity, tokens), "opened")
        done.append(new)
        fresh = new.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("gap")).where("gap > 0")
        more = materialize(fresh if gaps is None else gaps.unionByName(fresh), "gaps")
        if gaps is not None:
            discard(gaps)
        gaps = more
    if gaps is not None:
        discard(gaps)
    out = done[0] if done else items.select("id", "length", F.col("id").alias("seq"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text has the end token alone.  Pieces have numbers of their own, so repeated rows
    get places of their own and ties are broken; a null doc_id stays null.  An empty table gives an
    empty table.  Other columns are ignored, whatever their names."""
    with fewer_bytes(docs.sparkSession):
        cut = materialize(pieces(docs, path, capacity, end_id), "pieces")
    placed = best_fit(cut.select("id", "length"), capacity)
    # A sequence has at most `capacity` pieces.
    before = Window.partitionBy("seq").orderBy(F.col("length").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    places = placed.select("id", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return cut.join(places, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
