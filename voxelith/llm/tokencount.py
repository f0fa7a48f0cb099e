"""Token counts of a document's sections, by the tokens' character spans.

A whole document is encoded once.  A token's bytes give its byte span, and byte spans give
character spans; these are joined with the sections' intervals by binary search.  A token that
crosses a boundary is allocated by an explicit rule:

    start     to the section that holds its first character (the default)
    end       to the section that holds its last character
    majority  to the section that holds most of its characters, the earlier one of equals
    share     to each section in proportion to the characters it holds
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority", "share")


class Encoder:
    """Token ids and their byte lengths of whole texts, from a file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte place after each token."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def line_starts(text: str) -> list[int]:
    """Sections are lines, each with the newline that ends it."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    if len(out) > 1 and out[-1] == len(text):
        out.pop()
    return out


def char_starts(data: bytes) -> np.ndarray:
    """Byte place of each character, and of the end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.nonzero((raw & 0xC0) != 0x80)[0], len(raw))


def attribute(ends: np.ndarray, chars: np.ndarray, starts: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section.  ends: the tokens' byte ends.  chars: char_starts of the text.
    starts: the sections' first characters, ascending, the first 0.

    A token's characters are those that begin in it; one that holds only a character's later bytes
    belongs with that character."""
    n = len(starts)
    if not len(ends):
        return np.zeros(n, np.float64 if rule == "share" else np.int64)
    begin = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(chars, begin, "right") - 1
    last = np.searchsorted(chars, ends - 1, "right") - 1
    one = np.searchsorted(starts, first, "right") - 1
    two = np.searchsorted(starts, last, "right") - 1
    if rule == "start":
        return np.bincount(one, minlength=n)
    if rule == "end":
        return np.bincount(two, minlength=n)
    out = np.bincount(one[one == two], minlength=n).astype(np.float64)
    stops = np.append(starts[1:], len(chars) - 1)
    for t in np.nonzero(one != two)[0]:
        own = np.arange(one[t], two[t] + 1)
        held = np.minimum(stops[own], last[t] + 1) - np.maximum(starts[own], first[t])
        if rule == "share":
            out[own] += held / held.sum()
        else:
            out[own[np.argmax(held)]] += 1
    return out if rule == "share" else out.astype(np.int64)


def token_counts(
    docs: DataFrame, path: str, pattern: str, rule: str = "start", sections: Callable[[str], list[int]] = line_starts
) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, section, char_start, char_end, n_tokens), a row for each
    section of each row of docs.

    sections gives the first characters of a text's sections.  A null or empty text is one empty
    section without tokens.  Repeated rows give repeated sections.  An empty table gives an empty
    table.  n_tokens is a double under the rule `share` and a long under the others."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    number = pa.float64() if rule == "share" else pa.int64()
    names = ["doc_id", "section", "char_start", "char_end", "n_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids, ks, begins, stops, counts = [], [], [], [], []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[i].as_py() or ""
                starts = np.array(sections(text), np.int64)
                chars = char_starts(text.encode("utf-8", "surrogatepass"))
                counts.append(attribute(encoder.ends(text), chars, starts, rule))
                ids.append(pa.repeat(pa.scalar(doc, pa.int64()), len(starts)))
                ks.append(np.arange(len(starts)))
                begins.append(starts)
                stops.append(np.append(starts[1:], len(chars) - 1))
            if ids:
                cat = lambda xs, kind=pa.int64(): pa.array(np.concatenate(xs), kind)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), cat(ks), cat(begins), cat(stops), cat(counts, number)], names=names)

    kind = "double" if rule == "share" else "long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, f"doc_id long, section long, char_start long, char_end long, n_tokens {kind}"
    )
