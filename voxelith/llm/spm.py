"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input:

  normaliser  characters to characters: the space put before a text, spaces as U+2581, and, where
              the model squeezes them, runs of spaces as one
  pieces      characters to pieces: a tree whose ends go back to its root, put out a piece and weigh
              minus its score; a character without a piece puts out its byte pieces instead, at a
              weight above any piece's
  neighbours  an acceptor of pieces whose state is the piece before; an arc weighs 0 or infinity

The model is a BPE model, whose merges no sum of piece weights reproduces.  Merging is local, though:
a sequence of pieces is the model's encoding exactly if each two neighbours stay two when their
characters are merged, and that is what the acceptor's arcs weigh.  The tropical-semiring shortest
path through the composition is therefore the encoding.  States are composed when the search meets
them; arcs of the acceptor are compiled when first met and kept.

Pieces hold U+2581 at their start only, and no piece holds a line break, so paths factor there: an
input is a chain of segments, and a segment's path from a state of the normaliser is kept in a
bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_MOST_CACHED = 800_000
_INFINITE = float("inf")
#: Stands for every input symbol without an arc of its own, and in an output for that symbol.
OTHER = "\uffff"
START, BODY, GAP = 0, 1, 2
_SEGMENT = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+|\n")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


def normaliser(prefix: bool, squeeze: bool) -> list[dict[str, tuple[str, float, int]]]:
    """Arcs by state and input symbol: (output, weight, next state).  Every state is final; a state has
    one arc for a symbol, so the composition with a chain is a chain."""
    first = SPACE * prefix
    if not squeeze:
        return [
            {" ": (first + SPACE, 0.0, BODY), OTHER: (first + OTHER, 0.0, BODY)},
            {" ": (SPACE, 0.0, BODY), OTHER: (OTHER, 0.0, BODY)},
        ]
    return [
        {" ": ("", 0.0, START), OTHER: (first + OTHER, 0.0, BODY)},
        {" ": ("", 0.0, GAP), OTHER: (OTHER, 0.0, BODY)},
        {" ": ("", 0.0, GAP), OTHER: (SPACE + OTHER, 0.0, BODY)},
    ]


def loops(arcs: list[dict[str, tuple[str, float, int]]]) -> dict[int, dict[int, str]]:
    """Of each state whose arcs all come back to it, without weight and with one symbol for all others:
    its outputs by character, as str.translate takes them."""
    return {
        state: {ord(c): out for c, (out, _, _) in own.items() if c != OTHER}
        for state, own in enumerate(arcs)
        if own[OTHER][0] == OTHER and all(to == state and not w for _, w, to in own.values())
    }


class Transducer:
    """Encodes and decodes by a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for number, value in message:
            if number != 1:
                continue
            piece = dict(_fields(value))
            text, kind, i = piece[1].decode(), piece.get(3, 1), len(self.bytes_of)
            self.bytes_of.append(text.replace(SPACE, " ").encode())
            if kind == 6:
                byte = int(text[3:5], 16)
                self.byte_ids[byte] = i
                self.bytes_of[-1] = bytes([byte])
            elif kind == 1:
                self.ids[text] = i
                self.scores[text] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
            elif kind == 2:
                self.bytes_of[-1] = " ⁇ ".encode()
            elif kind == 3:
                self.bytes_of[-1] = b""
            else:
                raise ValueError(f"piece {i} is of kind {kind}, which is not supported")
        spec = dict(next((_fields(v) for n, v in message if n == 3), iter(())))
        trainer = dict(next((_fields(v) for n, v in message if n == 2), iter(())))
        if spec.get(2) or trainer.get(3, 1) != 2 or len(self.byte_ids) != 256:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        if any(SPACE in t.lstrip(SPACE) or ("\n" in t and t != "\n") for t in self.ids):
            raise ValueError("a piece crosses the places at which paths factor")
        self.prefix = bool(spec.get(3, 1))
        self.normaliser = normaliser(self.prefix, bool(spec.get(4, 1)))
        self.steady = all(arc[2] == BODY for arc in self.normaliser[BODY].values())
        self.loops = loops(self.normaliser)
        self.neighbours: dict[str | None, dict[str, float]] = {}
        self.known_pairs = 0
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.root = self.compile_pieces()
        self.byte_weight = 1.0 + max(-x for x in self.scores.values())
        self.paths: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored neighbours first, then the leftmost."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge gives piece."""
        parts = list(piece)
        while len(parts) > 2:
            at = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -_INFINITE), -i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts at the left (0) or right (1) end of piece while it is merged, each with the
        score of the merge that takes it in; piece itself is never taken in."""
        key = (piece, side)
        found = self.edges.get(key)
        if found is None:
            found, x = [(piece, -_INFINITE)], piece
            while len(x) > 1:
                score, x = self.scores[x], self.halves(x)[side]
                found.append((x, score))
            self.edges[key] = found
        return found

    def weight(self, a: str, b: str) -> float:
        """Of piece b after piece a: infinite if merging would join parts of the two before both
        are complete or afterwards.  Of equal scores the leftmost merge comes first."""
        row = self.neighbours.get(a)
        if row is None:
            row = self.neighbours[a] = {}
        w = row.get(b)
        if w is None:
            if a is None:  # the acceptor's first state takes any piece
                w = 0.0
            elif a[-1] == b[0] == SPACE:  # runs of spaces have equal scores
                w = 0.0 if self.merged(a + b) == [a, b] else _INFINITE
            else:
                w, scores, left = 0.0, self.scores, self.edge(b, 0)
                for x, taken_x in self.edge(a, 1):
                    for y, taken_y in left:
                        s = scores.get(x + y)
                        if s is not None and s > taken_x and s >= taken_y:
                            w = _INFINITE
            row[b] = w
            self.known_pairs += 1
        return w

    def compile_pieces(self) -> dict:
        """The piece transducer's root: arcs by character.  A state is (the arc back to the root, as
        (piece, weight), if a piece ends there; its arcs by character).  Pieces that merging their own
        characters does not give have no arc."""
        root: dict = {}
        for piece, score in self.scores.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                state = [None, root]
                for c in piece:
                    state = state[1].setdefault(c, [None, {}])
                state[0] = (piece, -score)
        return root

    def normalised(self, segment: str, state: int) -> tuple[str, float, int]:
        """The composition of a segment with the normaliser from state: output, weight, state after."""
        if state in self.loops:
            return segment.translate(self.loops[state]), 0.0, state
        arcs, out, total = self.normaliser, [], 0.0
        for c in segment:
            text, weight, state = arcs[state].get(c) or arcs[state][OTHER]
            out.append(text.replace(OTHER, c))
            total += weight
        return "".join(out), total, state

    def shortest(self, text: str) -> tuple[float, list[str]]:
        """Weight and pieces of the shortest path over normalised text, by relaxation from left to right.

        A state of the composition is a place in text with the piece that ends there, which is the
        acceptor's state.  Paths of finite weight to a place are encodings of the text before it, so
        they end with the same piece, and a place keeps the state that is nearest: its piece (last) and
        distance (cost).  An arc that cannot come nearer is not composed with the acceptor."""
        n, root, neighbours, weight = len(text), self.root, self.neighbours, self.weight
        last: list[str | None] = [None] * (n + 1)
        cost = [_INFINITE] * (n + 1) if n < 4096 else array("d", [_INFINITE]) * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            far = cost[i]
            if far == _INFINITE:
                continue
            known = last[i]
            row = neighbours.get(known, {})
            state, k = root.get(text[i]), i
            if state is None or state[0] is None:  # its bytes are put out when the path is read
                state = [(text[i], self.byte_weight), {} if state is None else state[1]]
            while state is not None:
                k += 1
                arc = state[0]
                if arc is not None and far + arc[1] < cost[k]:
                    piece = arc[0]
                    w = row.get(piece)
                    total = far + arc[1] + (weight(known, piece) if w is None else w)
                    if total < cost[k]:
                        last[k], cost[k] = piece, total
                state = state[1].get(text[k]) if k < n else None
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return cost[n], out[::-1]

    def path(self, segment: str, state: int) -> tuple[bytes, int]:
        """Ids of the shortest path over a segment from a state of the normaliser, and the state after."""
        if self.known_pairs > _MOST_CACHED:
            self.neighbours.clear()
            self.known_pairs = 0
        text, _, after = self.normalised(segment, state)
        ids: list[int] = []
        for piece in self.shortest(text)[1]:
            i = self.ids.get(piece)
            ids += [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return struct.pack(f"<{len(ids)}I", *ids), after

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts, out, state, known = _SEGMENT.findall(text), [], START, self.paths
        for k, part in enumerate(parts):
            if state == BODY and self.steady:  # all that follows starts from this state
                if len(known) > _MOST_CACHED:
                    known.clear()
                rest = parts[k:]
                for p in set(rest).difference(known):
                    known[p] = self.path(p, BODY)[0]
                out += map(known.__getitem__, rest)
                break
            ids, state = self.path(part, state)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: the piece transducer read from its outputs to its inputs, and the normaliser's
        first space taken off; bytes that are not UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


_models: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One a Python worker: what is compiled outlives the task."""
    if path not in _models:
        _models[path] = Transducer(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids array<int>), a row for each row of docs; a null or
    empty text has no ids, repeated rows stay, an empty table gives an empty table, and other columns are
    ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            packed = [model.encode(t.as_py() or "") for t in batch.column(1)]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded(doc_id, ids, ...) -> (doc_id, text), a row for each row of coded; null ids give a null
    text, no ids an empty one.  Repeated rows stay, an empty table gives an empty table, and other
    columns are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            texts = [None if (x := v.as_py()) is None else model.decode(np.array(x, "<u4").tobytes()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


REPORT = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def report(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text of docs(doc_id, text, ...): the number and CRC-32 of its ids, the
    SHA-256 of the decoded text, and whether that is the text (null: empty).  A row for each row of docs,
    repeated ones too; an empty table gives an empty table, and other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                ids = model.encode(text)
                back = model.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in REPORT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, REPORT)
